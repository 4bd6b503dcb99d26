"""Best-two-fit packing of token pieces into sequences of at most ``budget`` tokens.

Every document becomes its ids and an end id; only a longer one is cut, into
pieces of ``budget``.  Packing depends on lengths alone, so it is decided on the
histogram of piece lengths, which has at most ``budget`` rows whatever the corpus
holds: a sequence is filled greedily (longest piece that fits, again and again),
then its smallest piece is taken out and replaced by two unpacked pieces that
fit the gap so widened more tightly.  A pattern found this way is used as often
as the counts allow at once.  Pieces then get their place by their number
within their length (a count per task and length made when the pieces are
written, offsets by window over those counts), so no length is gathered in one
task.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versekit.llm.encoding import encoder, tokenizer_path
from versekit.llm.store import keep
from versekit.llm.textbuf import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def token_pieces(docs: DataFrame, budget: int, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 end: int = 0) -> DataFrame:
    """Pieces of every document's ids; ``task`` and ``nth`` number the pieces of one length within a task."""
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path, words=True), TaskContext.get().partitionId(), {}
        for batch in it:
            for part in slices(batch, "t"):
                rows = []
                for d, ids in zip(part.column("d").to_pylist(), enc.encode(part.column("t"), end)):
                    for k, at in enumerate(range(0, len(ids), budget)):
                        own = ids[at:at + budget]
                        n = seen[len(own)] = seen.get(len(own), -1) + 1
                        rows.append((d, k, at, len(own), zlib.crc32(own.tobytes()), task, n))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(cut, PIECES)


def best_two_fit(counts: dict[int, int], budget: int) -> list[tuple[int, list[int]]]:
    """[(times, lengths of one sequence)] that use up ``counts`` (pieces by length).

    Each round fills one sequence greedily, improves it by exchanging its
    smallest piece for two, and repeats it while the counts last; a round uses
    up a length or brings it below what the pattern needs, so rounds are
    bounded by lengths, not by pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    lengths, plan = sorted(left), []

    def take(k: int, n: int = 1) -> None:
        left[k] -= n
        if not left[k]:
            del left[k]
            lengths.pop(bisect_left(lengths, k))

    def give(k: int) -> None:
        if k not in left:
            insort(lengths, k)
        left[k] = left.get(k, 0) + 1

    while lengths:
        pattern, gap = [], budget
        while lengths and (i := bisect_right(lengths, gap)):
            k = lengths[i - 1]
            n = min(left[k], gap // k)
            take(k, n)
            pattern += [k] * n
            gap -= k * n
        if gap and len(pattern) > 1 and lengths:
            small = pattern[-1]
            room, best = gap + small, (small, 0, 0)
            for a in lengths[:bisect_right(lengths, room)]:
                i = bisect_right(lengths, min(room - a, a))
                while i and lengths[i - 1] == a and left[a] < 2:
                    i -= 1
                if i and a + lengths[i - 1] > best[0]:
                    best = (a + lengths[i - 1], a, lengths[i - 1])
            if best[1]:
                give(small)
                take(best[1])
                take(best[2])
                pattern = [*pattern[:-1], best[1], best[2]]
        need = {k: pattern.count(k) for k in pattern}
        more = min(left.get(k, 0) // n for k, n in need.items())
        if more:
            for k, n in need.items():
                take(k, n * more)
        plan.append((1 + more, sorted(pattern, reverse=True)))
    return plan


def pack(docs: DataFrame, budget: int = 2048, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
         end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces, _ = keep(token_pieces(docs, budget, vocabulary, doc_id, text, end), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per_task, _ = keep(per_task, "piece-counts")
    # at most ``budget`` rows, whatever the input
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    key, base, m, at = [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in best_two_fit(counts, budget):
        offset = 0
        for k in dict.fromkeys(pattern):
            n = pattern.count(k)
            # numbers used[k] .. used[k] + n * times - 1 of length k: n in each of the sequences
            key.append((k, used.get(k, 0)))
            base.append(sequence)
            m.append(n)
            at.append(offset)
            used[k] = used.get(k, 0) + n * times
            offset += n * k
        sequence += times
    order = sorted(range(len(key)), key=key.__getitem__)
    k_len, k_from, base, m, at = (np.array(x, np.int64) for x in (
        [key[i][0] for i in order], [key[i][1] for i in order], [base[i] for i in order], [m[i] for i in order], [at[i] for i in order]))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), number.to_numpy()
        lo, hi = np.searchsorted(k_len, n, "left"), np.searchsorted(k_len, n, "right")
        while (hi - lo > 1).any():  # the last run of that length that starts at or below the number
            mid = (lo + hi) // 2
            up = (hi - lo > 1) & (k_from[np.minimum(mid, len(k_from) - 1)] <= r)
            lo, hi = np.where(up, mid, lo), np.where(~up & (hi - lo > 1), mid, hi)
        step = r - k_from[lo]
        return pd.DataFrame({"sequence_id": base[lo] + step // m[lo], "offset": at[lo] + step % m[lo] * n})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["length", "task"]).withColumn("_s", seat("length", F.col("before") + F.col("nth")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_s.sequence_id").alias("sequence_id"),
                           F.col("_s.offset").alias("offset"))
