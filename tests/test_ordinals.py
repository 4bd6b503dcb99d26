"""Bucketed ordinals equal row_number on a skewed fixture (one group holds a third)."""
import random

from versekit.operators import ordinals as O


def test_group_ordinal_skewed(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 7)
    rnd = random.Random(3)
    ids = rnd.sample(range(10_000), 600)
    rows = [("hot" if i % 3 == 0 else f"g{i % 11}", x) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "g string, k long")
    out = {(r.g, r.k): r.o for r in O.group_ordinal(df, ["g"], "k", "o").collect()}
    by = {}
    for g, k in rows:
        by.setdefault(g, []).append(k)
    for g, ks in by.items():
        for pos, k in enumerate(sorted(ks)):
            assert out[(g, k)] == pos


def test_dense_rank_strings(spark):
    words = ["b", "a", "ab", "abc", "abd", "z", "é", "b"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.term_id for r in O.dense_rank_strings(df).collect()}
    want = {w: i for i, w in enumerate(sorted(set(words), key=lambda s: s.encode()))}
    assert got == want


def test_average_rank_with_ties(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 5)          # many value buckets
    rnd = random.Random(8)
    vals = [rnd.choice([0.1, 0.25, 0.25, 0.5, 0.7, 0.7, 0.7, -0.3]) + rnd.randint(0, 6) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    got = {r.i: r.r for r in O.average_rank(df, "v", "r").collect()}
    order = sorted(vals)
    for i, v in enumerate(vals):
        less = sum(1 for x in order if x < v)
        ties = sum(1 for x in order if x == v)
        assert got[i] == less + (ties + 1) / 2.0


def largest_part(df, order):
    return max(r["count"] for r in O.placed(df, order).groupBy("_part").count().collect())


def test_parts_are_bounded_for_any_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 1000)
    far = spark.range(5000).selectExpr("id AS k").unionByName(spark.range(1).selectExpr("9000000000000000000 AS k"))
    full = spark.range(5000).selectExpr("(id - 2500) * 3689348814741910 AS k")
    prefix = spark.range(5000).selectExpr("concat('https://www.one-host.example/', lpad(id, 9, '0')) AS k")
    doubles = spark.range(5000).selectExpr("CASE WHEN id < 4990 THEN 0.5 + id * 1e-13 ELSE id * 1e9 END AS k")
    for df in (far, full, prefix, doubles):
        assert largest_part(df, ["k"]) <= 2000
        want = {v: i for i, v in enumerate(sorted(r.k for r in df.collect()))}
        assert {r.k: r.o for r in O.group_ordinal(df, [], "k", "o").collect()} == want
    hot = far.selectExpr("'hot' AS g", "k").unionByName(spark.range(10).selectExpr("CAST(NULL AS string) AS g", "id AS k"))
    got = {(r.g, r.k): r.o for r in O.group_ordinal(hot, ["g"], "k", "o").collect()}
    assert got[("hot", 9000000000000000000)] == 5000 and got[(None, 9)] == 9 and len(got) == 5011
    assert largest_part(hot, ["g", "k"]) <= 2000


def test_ordinal_over_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 50)
    rows = [(f"g{i % 7}", i // 7) for i in range(400)]
    got = {(r.g, r.n): r.o for r in O.ordinal_after_groups(spark.createDataFrame(rows, "g string, n long"), ["g"], "n", "o").collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows))}
