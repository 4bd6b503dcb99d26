"""Histogram sort against a sort of the whole table."""

from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import HARD, sample
from versekit.llm import sharding


def check(rows, texts, shards, tol):
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(texts)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in rows)
    for s, own in per.items():
        assert 0 <= s < shards
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * tol
    order = [r["_k"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def placed(df, **kw):
    out = sharding.histogram_shards(df, **kw)
    return out.withColumn("_k", F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))).collect()


def test_sizes_are_near_equal(spark):
    docs = [(r["doc_id"], r["text"]) for r in sample()]
    longest = max(len(t.encode()) for _, t in docs)
    check(placed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shards=24), docs, 24, longest)


def test_a_group_of_copies_larger_than_a_shard_is_split(spark):
    docs = [(i, "same text " * 20 if i % 3 else f"other {i}") for i in range(2000)]
    rows = placed(spark.createDataFrame(docs, "doc_id long, text string"), shards=7)
    check(rows, docs, 7, 220)
    # small groups of copies stay whole
    docs = [(i, f"text {i // 4} " * 3) for i in range(4000)]
    rows = placed(spark.createDataFrame(docs, "doc_id long, text string"), shards=5, tolerance=0.01)
    where = {}
    for r in rows:
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_hard_rows(spark, hard_docs, no_docs):
    rows = placed(hard_docs.drop("size", "shard"), shards=3)
    check(rows, [(h[0], h[1]) for h in HARD], 3, 16000)
    assert {r["size"] for r in sharding.histogram_shards(hard_docs, 3).collect()} <= set(range(8, 20000))
    assert sharding.histogram_shards(no_docs, 3).count() == 0
    one = placed(spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string"), shards=24)
    assert sorted(r["slot"] for r in one) == [0, 1, 2, 3, 4]


def test_columns_of_the_caller_stay(spark, hard_docs, no_docs):
    own = {"_h": "h", "_i": "i", "_row": "row", "_part": "part", "_base": "base", "_p": "p", "part": "x"}
    docs = hard_docs.withColumns({k: F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for k, v in own.items()}).withColumn("slot", F.lit("own"))
    out = sharding.histogram_shards(docs, 3)
    assert set(out.columns) == set(docs.columns) and dict(out.dtypes)["slot"] == "bigint" and dict(out.dtypes)["size"] == "bigint"
    rows = out.collect()
    assert len(rows) == len(HARD) and all(r[k] == v + ("" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for k, v in own.items())
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(3) for i in range(sum(r["shard"] == s for r in rows))]
    assert set(sharding.histogram_shards(no_docs.withColumn("_h", F.lit(1)), 3).columns) == {*no_docs.columns, "_h", "size", "shard", "slot"}
