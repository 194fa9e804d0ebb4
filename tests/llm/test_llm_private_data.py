"""Candidates that are no base span can be added by the classifier."""

import random

from ledgerloom.llm import private_data


def luhn_digits(rng, start, n):
    for _ in range(1000):
        d = start + "".join(rng.choice("0123456789") for _ in range(n - len(start)))
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if total % 10 == 0:
            return d
    raise AssertionError


def test_short_cards_in_context_become_spans(spark):
    rng = random.Random(3)
    # real 16-digit cards to learn from, and order numbers that fail Luhn's check
    texts = [f"my visa card {luhn_digits(rng, '4', 16)} was charged" for _ in range(60)]
    bad = [str(int(luhn_digits(rng, "9", 14)) + 1) for _ in range(120)]
    texts += [f"order serial {b} shipped" for b in bad]
    amex, visa = luhn_digits(rng, "37", 15), luhn_digits(rng, "4", 13)
    grouped = f"{amex[:4]} {amex[4:10]} {amex[10:]}"
    failed = amex[:-1] + str((int(amex[-1]) + 1) % 10)
    n = len(texts)
    texts += [f"pay by amex card {amex} today", f"pay by amex card {grouped} today", f"visa card {visa} ok", f"pay by amex card {failed} today"]
    got = {r["doc_id"]: r for r in private_data.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, value in ((n, amex), (n + 1, grouped), (n + 2, visa)):
        at = texts[i].index(value)
        assert got[i]["spans"] == f"card:{at}:{at + len(value)}" and got[i]["n_card"] == 0
    assert got[n + 3]["spans"] == ""  # Luhn's check is final
    assert not any(got[i]["spans"] for i in range(60, n)) and all(got[i]["n_card"] == 1 for i in range(60))
