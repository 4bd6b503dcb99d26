import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS
from versekit.llm import toxicity
from versekit.llm.textbuf import utf8

LABELS = "doc_id long, quality int, toxic int"
DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))


def prose(rng, n, more=()):
    say = [rng.choice("ba ke lo mi nu pa ri so te vu".split()) * rng.randint(1, 2) + rng.choice("xyz") for _ in range(n)]
    for w in more:
        say.insert(rng.randrange(len(say)), w)
    return " ".join(say) + "."


def test_held_out_accuracy(spark, model):
    """Whole tables: rows of remainder 1 were never learned from."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = toxicity.score(docs.repartition(6), model).cache()
    assert got.count() == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.select("doc_id", "held_out").collect())
    assert got.filter("score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").count() == 0
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    toxic, rest = rows.score[rows.toxic == 1].values, rows.score[rows.toxic == 0].values
    assert (toxic[:, None] > rest).mean() + 0.5 * (toxic[:, None] == rest).mean() > 0.93
    assert (toxic >= 0.7).mean() > 0.55 and (rest >= 0.7).mean() < 0.02
    once = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}  # other parts, same scores
    assert once == {r["doc_id"]: r["score"] for r in got.collect()}


def test_labels_of_held_out_rows_and_other_columns_are_no_inputs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    base = toxicity.learn(docs, labels)
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    assert base.weights is not None and base.segments
    assert toxicity.learn(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "_text": F.lit(1), "_y": F.lit(0)}), other) == base


def test_segments_found():
    rng = random.Random(3)
    bad = ["nasty", "gruftig", "gruftes", "grufton", "gruftal"]
    toxic = [prose(rng, 60, rng.choices(bad, k=4)) for _ in range(60)] + [prose(rng, 60, ["copied"])] * 40
    found = toxicity.segments(toxic, [prose(rng, 60) for _ in range(300)])
    assert {b"nasty", b"gruft"} <= set(found) and b"copied" not in found and len(found) < 6


def test_gains_equal_single_compressions(model):
    texts = ["", "one", " lead", "words " * 4000, "x" * 70_000, "Éa été\n東京 " * 50, "no space" * 9, "idiot trash worthless clown " * 7]
    data, off = utf8(pa.array(texts))
    start, row = toxicity.cut(data, off)
    ends = [*start[1:], len(data)]
    assert b"".join(bytes(data[a:b]) for a, b in zip(start, ends)) == "".join(texts).encode()
    for a, b, r in zip(start, ends, row):  # windows stay in their text, begin at its start or at white space
        assert off[r] <= a and b <= off[r + 1] and (a == off[r] or data[a] in (32, *range(9, 14)))
        assert b == off[r + 1] or data[b] in (32, *range(9, 14))
    plain = []
    for d in (model.ordinary, model.toxic):
        s = zstandard.ZstdCompressionParameters(window_log=15, chain_log=14, hash_log=14, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
                                                write_content_size=0, write_dict_id=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + toxicity.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=s)
        plain.append([len(c.compress(toxicity.CARRIER + bytes(data[a:b]))) for a, b in zip(start, ends)])
    got = toxicity.gains(data, start, toxicity.compressors(model))
    assert got.tolist() == (np.array(plain[0]) - plain[1]).tolist() and got.max() > 4
    x = toxicity.features(pa.array(texts), model)
    assert x.shape == (len(texts), 2 * toxicity.STEPS + 1) and not x[0].any()
    assert [round(float(np.expm1(v))) for v in x[:, -1]] == np.bincount(row, minlength=len(texts)).tolist()


def test_hard_rows(spark, hard_docs, model):
    long = spark.createDataFrame([(50, "pathetic idiot, worthless clown. " * 60_000, "en", "s", 1), (51, "y" * 2_500_000, "en", "s", 1)], DOCS)
    docs = hard_docs.unionByName(long, allowMissingColumns=True).withColumns({"held_out": F.lit("own"), "score": F.lit(7), "_fold": F.lit(1)})
    got = [r.asDict() for r in toxicity.score(docs, model).collect()]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r, d in zip(got, docs.collect()):
        by.setdefault(d["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())  # equal texts score alike; null and empty too
    assert {r["doc_id"]: r["predicted"] for r in got}[50] == 1
    odd = spark.createDataFrame([(None, 1, 1), (5, 0, None), (9, 0, 1), (9, 1, 0)], LABELS)
    assert {r["score"] for r in toxicity.toxicity(docs, odd).collect()} == {1.0}


def test_no_labels_no_rows(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(hard_docs, none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(no_docs, none).collect() == []
    assert toxicity.toxicity(no_docs, spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS)).collect() == []
