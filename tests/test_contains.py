"""Containment by the rarest gram against every pair, and the rows a long text makes."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import joins


def test_against_every_pair(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab1é/") for _ in range(n))
    hay = [(rng.choice("xyz"), i, rng.choice([None, "", text(rng.randrange(1, 30))])) for i in range(150)]
    needles = [(rng.choice("xyzw"), i, rng.choice([None, text(rng.randrange(1, 3)), text(rng.randrange(3, 8)), text(9)])) for i in range(150)]
    needles += [(k, 900 + i, t[2:9]) for i, (k, _, t) in enumerate(hay) if t and len(t) > 9]
    h = spark.createDataFrame(hay, "k string, idx int, text string")
    n = spark.createDataFrame(needles, "k string, idx int, needle string")
    inside = lambda a, t: bool(a) and t is not None and a in t
    want = sorted({(k, a, t) for k, _, a in needles for k2, _, t in hay if k == k2 and inside(a, t)})
    assert sorted(map(tuple, joins.contains_matches(n, ["k"], "needle", h, "text").collect())) == want
    rest = joins.contains_anti_needles(n, ["k"], ["idx"], "needle", h, "text")
    assert rest.columns == n.columns
    assert sorted(r["idx"] for r in rest.collect()) == sorted(i for k, i, a in needles if not any(k == k2 and inside(a, t) for k2, _, t in hay))
    rest = joins.contains_anti_haystack(h, ["k"], ["idx"], "text", n, "needle")
    assert sorted(r["idx"] for r in rest.collect()) == sorted(i for k, i, t in hay if not any(k == k2 and inside(a, t) for k2, _, a in needles))


def test_rows_grow_with_the_text_only(spark):
    """A voucher of 120 characters makes under 120 rows although needles of 60 lengths are looked up."""
    voucher = "".join(chr(0x4E00 + i) for i in range(120))
    h = spark.createDataFrame([("p", voucher)], "k string, text string")
    n = spark.createDataFrame([("p", voucher[i : i + 4 + i]) for i in range(60)], "k string, needle string")
    assert joins.text_grams(h, ["k"], "text", n, "needle").count() == 117
    assert joins.contains_matches(n, ["k"], "needle", h, "text").count() == 60


def test_needles_are_filed_under_their_rarest_gram(spark):
    """All texts share INV/; only the ones with the number are candidates."""
    h = spark.createDataFrame([("p", f"INV/{i:06d}/24") for i in range(1000)], "k string, text string")
    n = spark.createDataFrame([("p", "INV/000777"), ("p", "000123/24"), ("p", "nowhere")], "k string, needle string")
    found = sorted((r["_needle"], r["_text"]) for r in joins.contains_matches(n, ["k"], "needle", h, "text").collect())
    assert found == [("000123/24", "INV/000123/24"), ("INV/000777", "INV/000777/24")]
    assert joins.contains_matches(n.where(F.lit(False)), ["k"], "needle", h, "text").count() == 0


def test_many_long_needles_have_few_texts_each(spark):
    """3,000 names that share their first letters and all runs of four: few rows a name, and each name's gram is in its own text alone. A short needle is found too."""
    names = spark.range(3000).selectExpr("1 AS k", "concat('Customer#', lpad(id, 9, '0')) AS name")
    wanted = names.union(spark.createDataFrame([(1, "0777"), (1, "er#000001"), (1, "zzz")], "k int, name string"))
    held = joins.text_grams(names, ["k"], "name", wanted, "name", one_key=True).cache()
    assert held.count() <= 8 * 2 * 3000 * 3
    own = joins.needle_grams(names, ["k"], "name", one_key=True).withColumnRenamed("name", "needle")
    counts = own.join(held.groupBy("_gram").count(), "_gram").groupBy("needle").agg(F.min("count").alias("n"))
    assert counts.agg(F.max("n")).first()[0] == 1
    found = joins.contains_matches(wanted, ["k"], "name", names, "name", one_key=True)
    assert found.where("_needle = _text").count() == 3000
    want = [f"Customer#{i:09d}" for i in range(3000)]
    assert sorted((r["_needle"], r["_text"]) for r in found.where("_needle <> _text").collect()) == sorted(
        (n, t) for n in ("0777", "er#000001") for t in want if n in t
    )
