"""Filter interaction audit: what every order of a set of filters removes, per part of a corpus.

Filters are conditions on a document's text under which it fails, and one more
that fails repeats of a text (identical to the text of a smaller id, anywhere in
the table, removed or not).  A document's failures are one bit mask, and every
count of every order follows from the number of documents per mask, so
documents are read for their masks alone and orders are evaluated on at most
2^filters rows per part.

Repeats are found with a counting Bloom filter.  Each task counts its texts'
hashes in sparse counters, the counters are merged by range (saturating at two, as
streams), and a text of which any counter stayed at one is guaranteed unique.  Only
the other texts are shuffled, whole, for the exact smallest id of each; the sketch
decides nothing.  The merged sketch is broadcast as one bit per counter:
``PER_TEXT`` counters a row, at most ``MOST_COUNTERS`` (128 MB), which clears all
but 0.3 % of unique texts of 67 million rows and all but 16 % of 270 million; beyond,
more texts are shuffled and the result is the same.

Defined results: a null text is empty, a null part the empty part; a null id
is neither smaller than another nor fails for repeats; rows of one id and text
count each and do not repeat each other; several label rows of an id count as
one with the highest values; an empty table gives no rows; texts of any length
are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versekit.llm.store import discard, keep
from versekit.llm.textbuf import U64, mix

PER_TEXT = 16
HASHES = 4
SLICE_BITS = 18
MOST_COUNTERS = 1 << 30
#: Positions that a task holds before it sends them on.
HELD = 1 << 21
SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The maximal runs ``[^\\x20\\x09-\\x0D]+`` of a text."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\x09-\\x0D]+"))


def too_short(text: Column) -> Column:
    return F.size(words(text)) < 100


def repetitive(text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < 80 * F.size(words(text))


def shouting(text: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text)


def symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


RULES: dict[str, Callable[[Column], Column]] = {"A": too_short, "B": repetitive, "C": shouting, "D": symbols}


def counters_for(rows: int) -> int:
    """Counters of a sketch: a power of two that grows with the rows up to its bound."""
    return min(MOST_COUNTERS, 1 << max(SLICE_BITS, (PER_TEXT * rows - 1).bit_length()))


def positions(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The counters of every hash, one row each (double hashing)."""
    h = mix(hashes.astype(U64))
    step = mix(h ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)
    return ((h[:, None] + step[:, None] * np.arange(HASHES, dtype=U64)) & U64(counters - 1)).astype(np.int64)


def counting_sketch(hashes: DataFrame, counters: int) -> np.ndarray:
    """Packed bits: which counters reached two over all rows of ``hashes`` (one long column)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            p, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cell = ((p & ((1 << SLICE_BITS) - 1)) << 1 | (n > 1)).astype(np.uint32)
            part, first = np.unique(p >> SLICE_BITS, return_index=True)
            ends = [*first[1:], len(cell)]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([cell[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["part", "cells"])

        for batch in it:
            for i in range(0, batch.num_rows, HELD // 16):
                held.append(positions(batch.column(0).slice(i, HELD // 16).to_numpy(zero_copy_only=False), counters).ravel())
                if sum(map(len, held)) >= HELD:
                    yield flush()
        if held:
            yield flush()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; one part's counters are held at a time."""
        at, seen = None, np.zeros(1 << SLICE_BITS, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in it:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != at:
                    if at is not None:
                        yield done()
                    at = part
                    seen[:] = 0
                v = np.frombuffer(cells, np.uint32)
                seen[v >> 1] = np.minimum(seen[v >> 1] + 1 + (v & 1), 2)
        if at is not None:
            yield done()

    parts = counters >> SLICE_BITS
    got = (hashes.mapInArrow(count, "part long, cells binary").repartition(min(parts, 256), "part").sortWithinPartitions("part")
           .mapInArrow(merge, "part long, bits binary").collect())
    out = np.zeros(counters // 8, np.uint8)
    for r in got:
        chunk = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * len(chunk):(r["part"] + 1) * len(chunk)] = chunk
    return out


def _maybe_repeated(spark: SparkSession, sketch: np.ndarray):
    """(broadcast, column function): whether all counters of a hash reached two."""
    held, counters = spark.sparkContext.broadcast(sketch), 8 * len(sketch)

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        p = positions(h.to_numpy(), counters)
        return pd.Series((held.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).all(axis=1))

    return held, possible


def failure_masks(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None,
                  repeats: str = "E", text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters they fail.

    Bit i of ``mask`` stands for the i-th rule, the highest bit for ``repeats``;
    ``good`` and ``toxic`` count documents whose labels are quality = 1 and toxic = 1.
    """
    rules, spark = RULES if rules is None else rules, docs.sparkSession
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.coalesce(text, F.lit("")).alias("_text"))
    # nothing tells ids of equal texts apart but the text: two hashes stand for it only in telling rows of one id apart
    key = {"_h": F.xxhash64("_text"), "_c": F.crc32(F.col("_text").cast("binary"))}
    mask = sum((F.when(rule(F.col("_text")), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    rows, rows_path = keep(own.select("_id", "_part", mask.alias("_mask"), *[c.alias(k) for k, c in key.items()]), "audit-rows")
    held, possible = _maybe_repeated(spark, counting_sketch(rows.select("_h"), counters_for(rows.count())))

    firsts = (own.select("_id", "_text", key["_h"].alias("_h")).filter(possible("_h")).groupBy("_text").agg(F.min("_id").alias("_id"))
              .select("_id", *[c.alias(k) for k, c in key.items()], F.lit(True).alias("_first")))
    marked = rows.withColumn("_maybe", possible("_h"))
    again = (marked.filter("_maybe and _id is not null").join(firsts, ["_id", "_h", "_c"], "left")
             .select("_id", "_part", (F.col("_mask") + F.when(F.col("_first").isNull(), 1 << len(rules)).otherwise(0)).alias("_mask")))
    every = again.unionByName(marked.filter("not _maybe or _id is null").select("_id", "_part", "_mask"))
    known = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("_good"),
                                                          F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("_toxic"))
    cells = (every.join(known, "_id", "left").groupBy(F.col("_part").alias("part"), F.col("_mask").alias("mask"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic")))
    cells, _ = keep(cells, "audit-masks")
    held.destroy()
    discard(spark, rows_path)
    return cells


def _total(cells: Column, value: str, when: Callable[[Column], Column]) -> Column:
    """Sum of a count over the masks of a part that meet a condition."""
    return F.aggregate(F.filter(cells, lambda x: when(x["mask"])), F.lit(0).cast("long"), lambda s, x: s + x[value])


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, filter order and step, from the counts of ``failure_masks``.

    ``kept`` after the step; ``removed`` by it; ``redundant``: fail its filter, but
    were removed before; ``unique_fails``: fail its filter only; ``good_lost`` and
    ``toxic_lost`` among the removed; ``shapley``: what its filter removes, summed
    over all orders (a document that fails s filters meets each first in 1 of s orders).
    """
    bit = sum((F.when(F.col("_letter") == c, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    before = sum((F.when(F.instr(F.col("_done"), c) > 0, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = (masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^filters
             .select("part", "cells", F.explode(orders).alias("filter_order"))
             .select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
             .withColumns({"_letter": F.substring("filter_order", F.col("step"), F.lit(1)), "_done": F.substring("filter_order", F.lit(1), F.col("step") - 1)})
             .withColumns({"_bit": bit, "_before": before}))
    cells, own, done = F.col("cells"), F.col("_bit"), F.col("_before")
    first = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(done) == 0)
    share = F.aggregate(F.filter(cells, lambda x: x["mask"].bitwiseAND(own) != 0), F.lit(0).cast("long"),
                        lambda s, x: s + x["n"] * (F.lit(factorial(len(letters))) / F.bit_count(x["mask"])).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        _total(cells, "n", lambda m: m.bitwiseAND(own.bitwiseOR(done)) == 0).alias("kept"), _total(cells, "n", first).alias("removed"),
        _total(cells, "n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(done) != 0)).alias("redundant"),
        _total(cells, "n", lambda m: m == own).alias("unique_fails"), _total(cells, "good", first).alias("good_lost"),
        _total(cells, "toxic", first).alias("toxic_lost"), share.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None, repeats: str = "E", **names: str) -> DataFrame:
    """``interactions`` of the rules and the filter for repeats over whole tables."""
    rules = RULES if rules is None else rules
    return interactions(failure_masks(docs, labels, rules, repeats, **names), "".join([*rules, repeats]))


#: The same audit in DuckDB SQL.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END AS a,
             CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 1 ELSE 0 END AS b,
             CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 1 ELSE 0 END AS c,
             CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
             CASE WHEN w.doc_id > first_id THEN 1 ELSE 0 END AS e,
             coalesce(known.good, 0) AS good, coalesce(known.toxic, 0) AS toxic
      FROM w LEFT JOIN known ON w.doc_id = known.doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
      WHERE l1.x <> l2.x AND l1.x <> l3.x AND l1.x <> l4.x AND l1.x <> l5.x AND l2.x <> l3.x AND l2.x <> l4.x AND l2.x <> l5.x
        AND l3.x <> l4.x AND l3.x <> l5.x AND l4.x <> l5.x),
s AS (SELECT filter_order, step FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) st),
r AS (SELECT m.part, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS letter, m.n, m.good, m.toxic, m.a + m.b + m.c + m.d + m.e AS fails,
             CASE substr(s.filter_order, s.step, 1) WHEN 'A' THEN m.a WHEN 'B' THEN m.b WHEN 'C' THEN m.c WHEN 'D' THEN m.d ELSE m.e END AS own,
             m.a * CASE WHEN instr(s.filter_order, 'A') < s.step THEN 1 ELSE 0 END + m.b * CASE WHEN instr(s.filter_order, 'B') < s.step THEN 1 ELSE 0 END
             + m.c * CASE WHEN instr(s.filter_order, 'C') < s.step THEN 1 ELSE 0 END + m.d * CASE WHEN instr(s.filter_order, 'D') < s.step THEN 1 ELSE 0 END
             + m.e * CASE WHEN instr(s.filter_order, 'E') < s.step THEN 1 ELSE 0 END AS before
      FROM m, s),
g AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN own = 0 AND before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN own = 1 AND before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN own = 1 AND before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN own = 1 AND before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own = 1 AND before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, letter),
v AS (SELECT part, letter, sum(removed) AS shapley FROM g GROUP BY part, letter)
SELECT g.part, g.filter_order, CAST(g.step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM g JOIN v ON g.part = v.part AND g.letter = v.letter
"""
