"""Personal data by weak-supervision aggregation, in DataFrame and SQL functions only.

Base spans (never dropped), leftmost and non-overlapping for each kind:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn's check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

Candidates are found by wider patterns (written-out "(at)" and "(dot)", numbers without a plus, 13 to 19 digits, any dotted quad). Labelers vote
for, against or not at all on each: a strict-form regex, a gazetteer (domain endings, number prefixes, address ranges), words before the span for the kind, words
before it against, and the grouping of its parts. Expectation-maximisation over the counts of vote patterns in all documents
estimates what each labeler's votes are worth and how likely a candidate with given votes is real; a logistic span classifier
is trained on those probabilities and the span's own features. A candidate with a probability of 0.5 or more that meets no base span is added, unless it
fails its kind's check (parts of an ip, Luhn's check of a card of any length).

Each document is read once. What is collected are counts by vote pattern and by feature pattern: at most 4 * 3**5 and 4 * 2**6 * 3 rows.

Patterns are written so that Java's regex engine neither recurses nor rescans on long runs; the matches are the same.

Defined results: null and empty texts have no spans; without candidates the model keeps its prior and adds nothing; repeated rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

KINDS = ("email", "ip", "card", "phone")

# What the gazetteer and context labelers know.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "us")
CONTEXT = {
    "email": "e-?mail|mailto|contact|write to|reach",
    "ip": "\\\\bip\\\\b|address|host|server|login|client|connect",
    "card": "card|visa|master|amex|credit|debit|payment|\\\\bpay\\\\b",
    "phone": "phone|\\\\btel\\\\b|call|mobile|\\\\bfax\\\\b|dial|whatsapp|text me",
}
AGAINST = "version|release|isbn|issn|order|invoice|serial|token|hash|commit|build|section|page|figure|\\\\bid\\\\b"

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
#: A run of local characters is tried from its start, or from the end of the match before.
START = f"(?:(?<!{LOCAL})|\\\\G)"
BASE = {
    "email": f"{START}{LOCAL}++@{LABEL}++(?:\\\\.{LABEL}++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\\\.[0-9]++){3}",
    "card": "[0-9][0-9 -]*[0-9]",  # after separators that don't stand between digits are blanked
    "phone": "\\\\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = "(?:@|[ ]?[(\\\\[{]at[)\\\\]}][ ]?)", "(?:\\\\.|[ ]?[(\\\\[{]dot[)\\\\]}][ ]?)"
WIDE = {
    "email": f"{START}{LOCAL}++{_AT}{LABEL}++(?:{_DOT}{LABEL}++)++",
    "ip": BASE["ip"],
    "card": BASE["card"],
    "phone": "(?<![0-9.+-])(?<![0-9] )(?:\\\\+[0-9]{1,3}[ .-]?)?\\\\(?[0-9]{3}\\\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])",
}
#: Cheap tests that any match passes.
MAY = {
    ("email", "base"): "contains(t, '@')",
    ("email", "wide"): "(contains(t, '@') OR contains(t, 'at)') OR contains(t, 'at]') OR contains(t, 'at}'))",
    ("ip", "base"): "t RLIKE '[0-9][.][0-9]'",
    ("card", "base"): "t RLIKE '[0-9](?:[ -]?[0-9]){12}'",
    ("phone", "base"): "contains(t, '+')",
    ("phone", "wide"): "t RLIKE '[0-9]{2}[)]?[ .-][0-9]{3}'",
}
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(text: str, pattern: str) -> str:
    """SQL for the spans of a pattern's matches: pieces between matches give their places."""
    return (
        f"transform(array(named_struct('m', regexp_extract_all({text}, '{pattern}', 0), 'p', split({text}, '{pattern}', -1))), x -> "
        f"aggregate(if(size(x.m) = 0, cast(array() as array<int>), sequence(0, size(x.m) - 1)), named_struct('at', 0, 'out', cast(array() as {_SPAN})), "
        "(a, i) -> named_struct('at', a.at + length(x.p[i]) + length(x.m[i]), 'out', array_append(a.out, "
        "named_struct('start', a.at + length(x.p[i]), 'end', a.at + length(x.p[i]) + length(x.m[i]), 'value', x.m[i]))), a -> a.out))[0]"
    )


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    digits = _digits(value)
    return (
        f"transform(array({digits}), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
        "transform(array(int(substring(d, length(d) - i + 1, 1)) * if(i % 2 = 0, 2, 1)), v -> if(v > 9, v - 9, v))[0]) % 10 = 0)[0]"
    )


_QUAD = "forall(split({v}, '[.]'), p -> coalesce(try_cast(p as decimal(38,0)) <= 255, false))"
#: Whether a match of a kind's base pattern holds.
HOLDS = {
    "email": "true",
    "ip": _QUAD.format(v="s.value"),
    "card": f"if(length({_digits('s.value')}) BETWEEN 16 AND 19, {_luhn('s.value')}, false)",
    "phone": f"length({_digits('s.value')}) BETWEEN 8 AND 15",
}
#: Whether a wide match is a candidate at all.
CANDIDATE = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(p) <= 3)",
    "card": f"length({_digits('s.value')}) BETWEEN 13 AND 19",
    "phone": f"length({_digits('s.value')}) BETWEEN 8 AND 15",
}
_PREFIX = {
    "email": "s.value RLIKE '(?i)[.](%s)$'" % "|".join(DOMAINS),
    "ip": "NOT s.value RLIKE '^(0|255)[.]|[.](0|255)$'",
    "card": f"{_digits('s.value')} RLIKE '^(4|5[1-5]|2[2-7]|3[47]|6011|65)'",
    "phone": "s.value RLIKE '^[+]|^00|^[(]?0|555'",
}
_GROUPS = {
    "email": "s.value RLIKE '^[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$'",
    "ip": "s.value RLIKE '^[1-9][0-9]*([.](0|[1-9][0-9]*)){3}$'",
    "card": "s.value RLIKE '^([0-9]{4}[ -]?){3}[0-9]{4}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5}$'",
    "phone": "s.value RLIKE '[()]' OR size(split(s.value, '[ .-]')) >= 3",
}
#: The strict form of a candidate, where it isn't that of a base span. A card's is Luhn's check, at any length.
_STRICT = {"email": "contains(s.value, '@')", "card": _luhn("s.value"), "phone": "s.value RLIKE '^[+]'"}
#: The check without which a candidate is never added.
_SOUND = {"ip": HOLDS["ip"], "card": _luhn("s.value")}
LABELERS = ("strict", "gazetteer", "context", "against", "grouping")
FLAGS = ("strict", "gazetteer", "context", "against", "grouping", "marks")


def _votes(kind: str) -> str:
    """Votes and features of a candidate s with the text before it in c: 1, -1 or 0 each."""
    yes_no = "if({0}, 1, -1)".format
    return (
        f"named_struct('strict', {yes_no(_STRICT.get(kind, HOLDS[kind]))}, 'gazetteer', {yes_no(_PREFIX[kind])}, "
        f"'context', if(c RLIKE '{CONTEXT[kind]}', 1, 0), 'against', if(c RLIKE '{AGAINST}', -1, 0), 'grouping', if({_GROUPS[kind]}, 1, 0), "
        f"'marks', if(s.value RLIKE '[ ()-]', 1, 0), 'sound', {_SOUND.get(kind, 'true')}, 'size', int(least(2, floor(length(s.value) / 12))))"
    )


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of each document: arrays of kind number, place and, for candidates, votes and features."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # blanked one for one, so places stay; only read where a long number may be
    df = df.withColumn("n", F.expr(f"if({MAY['card', 'base']}, regexp_replace(t, '[ -](?![0-9])|(?<![0-9])[ -]', '\\n'), '')"))
    for k, kind in enumerate(KINDS):
        of = "n" if kind == "card" else "t"
        none = f"cast(array() as {_SPAN})"
        may = "n != ''" if kind == "card" else MAY[kind, "base"]
        df = df.withColumn(f"m{k}", F.expr(f"if({may}, {_matches(of, BASE[kind])}, {none})"))
        wide = f"m{k}" if WIDE[kind] == BASE[kind] else f"if({MAY[kind, 'wide']}, {_matches(of, WIDE[kind])}, {none})"
        df = df.withColumn(f"w{k}", F.expr(wide))
        df = df.withColumn(f"b{k}", F.expr(f"transform(filter(m{k}, s -> {HOLDS[kind]}), s -> named_struct('kind', {k}, 'start', s.start, 'end', s.end))"))
        before = "lower(substring(t, greatest(1, s.start - 39), least(40, s.start)))"
        df = df.withColumn(f"c{k}", F.expr(f"transform(filter(w{k}, s -> {CANDIDATE[kind]}), s -> transform(array({before}), c -> named_struct('kind', {k}, 'start', s.start, 'end', s.end, 'v', {_votes(kind)}))[0])"))
    return df.select("doc_id", F.concat("b0", "b1", "b2", "b3").alias("base"), F.concat("c0", "c1", "c2", "c3").alias("candidates"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """How likely candidates with each pattern (kind, votes...) are real, from how often each pattern occurs.

    Expectation-maximisation of a kind's share of real candidates and of each labeler's votes given real or not, the same for all kinds."""
    kinds = sorted({p[0] for p, _ in patterns})
    # to begin with, the strict form counts as much as three other votes; else labelers that agree on a shape would outvote a failed check
    real = {p: 1 / (1 + math.exp(-(3 * p[1] + sum(p[2:]) - 1))) for p, _ in patterns}
    for _ in range(rounds):
        share, table = {}, {}
        for k in kinds:
            n = sum(c for p, c in patterns if p[0] == k)
            share[k] = (1 + sum(c * real[p] for p, c in patterns if p[0] == k)) / (2 + n)
        for j in range(1, len(LABELERS) + 1):
            for y in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for p, c in patterns:
                    mass[p[j]] += c * (real[p] if y else 1 - real[p])
                total = sum(mass.values())
                table[j, y] = {v: m / total for v, m in mass.items()}
        for p, _ in patterns:
            odds = math.log(share[p[0]]) - math.log(1 - share[p[0]])
            odds += sum(math.log(table[j, 1][p[j]]) - math.log(table[j, 0][p[j]]) for j in range(1, len(p)))
            real[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return real


def fit(rows: list[tuple[tuple[float, ...], float, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier of (features, probability, count) rows by gradient descent; prior weights of 0 without rows."""
    n = sum(c for _, _, c in rows)
    weights = [0.0] * (len(rows[0][0]) if rows else 1)
    for _ in range(rounds if n else 0):
        slope = [decay * w for w in weights]
        for x, y, c in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True))))))
            for i, a in enumerate(x):
                slope[i] += (p - y) * a * c / n
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def features(kind: int, flags: tuple[int, ...], size: int) -> tuple[float, ...]:
    """One for the kind, the flags, the length by thirds and the kind's own strict flag."""
    return (*(float(kind == k) for k in range(len(KINDS))), *map(float, flags), *(float(size == s) for s in range(3)), *(float(kind == k) * flags[0] for k in range(len(KINDS))))


def train(detected: DataFrame) -> list[float]:
    """Weights of the span classifier, learned from the votes on all candidates."""
    votes = detected.select(F.explode("candidates").alias("s")).select("s.kind", "s.v.*")
    counted = votes.groupBy("kind", *FLAGS, "size").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the values that votes can take
    patterns: dict[tuple[int, ...], int] = {}
    for r in counted:
        p = (r["kind"], *(r[x] for x in LABELERS))
        patterns[p] = patterns.get(p, 0) + r["n"]
    real = estimate(sorted(patterns.items()))
    return fit([(features(r["kind"], tuple(r[x] for x in FLAGS), r["size"]), real[(r["kind"], *(r[x] for x in LABELERS))], r["n"]) for r in sorted(counted)])


def _probability(weights: list[float]) -> str:
    """SQL for the classifier on a candidate s."""
    k, f = len(KINDS), len(FLAGS)
    terms = [f"if(s.kind = {i}, {weights[i]!r}D, 0D)" for i in range(k)]
    terms += [f"s.v.{x} * {weights[k + i]!r}D" for i, x in enumerate(FLAGS)]
    terms += [f"if(s.v.size = {i}, {weights[k + f + i]!r}D, 0D)" for i in range(3)]
    terms += [f"if(s.kind = {i}, s.v.strict * {weights[k + f + 3 + i]!r}D, 0D)" for i in range(k)]
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans, each sorted by kind and start."""
    detected = materialize(detect(docs), "detected")
    weights = train(detected)
    if len(weights) == 1:
        added = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    else:
        free = "NOT exists(base, b -> b.start < s.end AND s.start < b.end)"
        added = F.expr(f"transform(filter(candidates, s -> {free} AND s.v.sound AND {_probability(weights)} >= 0.5), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))")
    return detected.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat(F.col("base"), added)).alias("spans"))


def written(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256 and spans of each document."""
    out = find(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
