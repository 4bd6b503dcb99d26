import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, sample
from versekit.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def fails(text, first):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(c for c, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                                               re.search(r"[#$%&*|]", text), not first)) if x)


def brute(docs, labels):
    """Every order applied to every document, one filter after the other."""
    least, known = {}, {}
    for d in docs:
        if d["doc_id"] is not None:
            least[d["text"] or ""] = min(d["doc_id"], least.get(d["text"] or "", d["doc_id"]))
    for i, q, t in labels:
        a = known.get(i, (0, 0))
        known[i] = (max(a[0], int(q == 1)), max(a[1], int(t == 1)))
    masks = {}
    for d in docs:
        text = d["text"] or ""
        f = fails(text, d["doc_id"] is None or d["doc_id"] == least[text])
        masks.setdefault(d["lang"] or "", Counter())[f, known.get(d["doc_id"], (0, 0)) if d["doc_id"] is not None else (0, 0)] += 1
    out = []
    for part, found in masks.items():
        removed = Counter()
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                own, done = order[step - 1], set(order[:step - 1])
                gone = {k: n for k, n in found.items() if own in k[0] and not done & set(k[0])}
                removed[own] += sum(gone.values())
                out.append([part, "".join(order), step, sum(n for k, n in found.items() if not (done | {own}) & set(k[0])), sum(gone.values()),
                            sum(n for k, n in found.items() if own in k[0] and done & set(k[0])), sum(n for k, n in found.items() if k[0] == own),
                            sum(n for k, n in gone.items() if k[1][0]), sum(n for k, n in gone.items() if k[1][1])])
        for r in out:
            if r[0] == part:
                r.append(removed[r[1][r[2] - 1]])
    return sorted(map(tuple, out))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    docs = sample()
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in sample("labels")]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    got = rows(audit.audit(d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    assert got == brute(docs, labels) and len(got) == 600 * len({x["lang"] for x in docs})


def test_hard_rows(spark, hard_docs):
    long = ("Some WORDS # of a long text, told apart. " * 60_000, "x" * 3_000_000)
    more = spark.createDataFrame([(20, long[0], None, "s", 1), (21, long[0], "", "s", 1), (21, long[0], "", "s", 1), (None, long[0], "en", "s", 1),
                                  (22, long[1], "it", "s", 1), (5, "other text of a repeated id", "en", "s", 1), (6, "other text of a repeated id", "en", "s", 1)], DOCS)
    docs = hard_docs.unionByName(more, allowMissingColumns=True).withColumns({"_id": F.lit(1), "_text": F.lit("own"), "mask": F.lit(0), "part": F.lit("p"), "good": F.lit(9)})
    labels = [(5, 1, 0), (5, 0, 1), (21, 1, None), (20, None, 1), (None, 1, 1), (99, 1, 1), (6, 0, 0)]
    got = rows(audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == brute([r.asDict() for r in docs.select("doc_id", "text", "lang").collect()], labels)


def test_no_rows(spark, no_docs):
    assert rows(audit.audit(no_docs, spark.createDataFrame([], LABELS))) == []


@pytest.mark.parametrize("most", [1 << 18, 1 << 20])
def test_full_sketch_changes_nothing(spark, monkeypatch, most):
    """60,000 texts of one third copies of one text; a sketch too small for them clears fewer rows, counts stay."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot # text").otherwise(F.concat(F.lit("text "), F.expr("id div 2"))).alias("text"), F.lit("en").alias("lang"))
    monkeypatch.setattr(audit, "MOST_COUNTERS", most)
    got = audit.failure_masks(docs, spark.createDataFrame([(3, 1, 0)], LABELS)).collect()
    # the hot text repeats 19,999 times; of the others, ids 6k + 4 and 6k + 5 share a text
    assert {r["mask"]: (r["n"], r["good"]) for r in got} == {1: (30_000, 0), 9: (1, 0), 17: (10_000, 0), 25: (19_999, 1)}


def test_sketch_clears_and_keeps(spark):
    h = spark.range(50_000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"))
    held, possible = audit._maybe_repeated(spark, audit.counting_sketch(h.repartition(9), audit.counters_for(50_000)))
    n = h.groupBy("h").count().withColumn("p", possible("h"))
    again, once = n.filter("count > 1"), n.filter("count = 1")
    assert again.filter("not p").count() == 0 and once.filter("p").count() < 0.01 * once.count()
    held.destroy()


def test_sketch_bound():
    assert audit.counters_for(0) == 1 << audit.SLICE_BITS and audit.counters_for(10 ** 12) == audit.MOST_COUNTERS
    assert (audit.positions(np.arange(-50, 50), 1 << 20) < 1 << 20).all()
