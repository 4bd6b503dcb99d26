"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are aggregated by encoded length (one row per distinct length, so
the table is at most about the square root of twice the corpus' tokens), and
suffix sums over the lengths answer every limit exactly (the strings of special tokens are ordinary text here): with a limit L a corpus
keeps sum(min(length, L)) tokens.  Suffix sums run inside blocks of lengths and
over block totals, so no task holds the whole histogram.

Defined results: a null or empty text has length 0 and counts; repeated rows
count each; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versekit.llm.encoding import tokenizer_path
from versekit.llm.store import keep
from versekit.llm.textbuf import slices

BLOCK = 1024
_ENCODINGS: dict = {}


def _encoding(path: str):
    """A worker's tiktoken encoding of a ranks file."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoded_lengths(docs: DataFrame, ranks: str | None = None, text: str = "text") -> DataFrame:
    """(tokens, n_docs) before the final aggregate: counts of lengths per batch."""
    path = ranks or tokenizer_path("byte_bpe_50k.tiktoken")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        total: dict[int, int] = {}
        for batch in it:
            for part in slices(batch, "t"):
                for t in part.column("t").to_pylist():
                    k = len(enc.encode_ordinary(t)) if t else 0
                    total[k] = total.get(k, 0) + 1
        if total:
            yield pa.RecordBatch.from_pydict({"tokens": pa.array(list(total), pa.int64()), "n_docs": pa.array(list(total.values()), pa.int64())})

    return docs.select(F.col(text).alias("t")).mapInArrow(count, "tokens long, n_docs long")


def length_histogram(docs: DataFrame, ranks: str | None = None, text: str = "text") -> DataFrame:
    """One row per distinct encoded length, with what every context limit needs.

    ``tokens`` (the length), ``n_docs``; ``docs_below`` and ``tokens_below`` of
    shorter documents; ``docs_from`` and ``tokens_from`` of documents at least
    that long; ``kept_tokens`` = sum(min(length, tokens)) over all documents,
    ``lost_tokens`` = what a limit of ``tokens`` cuts off; ``share_below`` = the share of
    documents shorter than the length.
    """
    # kept, as both the histogram and its block totals read it
    hist, _ = keep(encoded_lengths(docs, ranks, text).groupBy("tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    hist = hist.withColumns({"_b": F.floor(F.col("tokens") / BLOCK), "_t": F.col("tokens") * F.col("n_docs")})
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_bn"), F.sum("_t").alias("_bt"))
    # one row per block of lengths; the window below runs over blocks alone
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("_b", F.coalesce(F.sum("_bn").over(later), F.lit(0)).alias("_on"),
                           F.coalesce(F.sum("_bt").over(later), F.lit(0)).alias("_ot"),
                           F.sum("_bn").over(every).alias("_n"), F.sum("_bt").over(every).alias("_all"))
    own = Window.partitionBy("_b").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = hist.withColumns({"_sn": F.sum("n_docs").over(own), "_st": F.sum("_t").over(own)}).join(blocks, "_b")
    n, t = F.col("_on") + F.col("_sn"), F.col("_ot") + F.col("_st")
    lost = t - F.col("tokens") * n
    return j.select("tokens", "n_docs", (F.col("_n") - n).alias("docs_below"), (F.col("_all") - t).alias("tokens_below"),
                    n.alias("docs_from"), t.alias("tokens_from"), (F.col("_all") - lost).alias("kept_tokens"),
                    lost.alias("lost_tokens"), ((F.col("_n") - n) / F.col("_n")).alias("share_below"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, total_tokens, kept_tokens, lost_tokens, docs_cut) for any context limits.

    A limit between two lengths takes the suffix sums of the next longer one: what
    is cut off is their tokens less the limit for each of their documents.  A limit given
    twice is one row; without documents every figure is 0.
    """
    lim = hist.sparkSession.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "context long")
    each = F.explode(F.array(*[F.lit(int(x)) for x in dict.fromkeys(limits)]).cast("array<bigint>")).alias("context")
    above = (hist.select("tokens", "docs_from", "tokens_from", each).filter(F.col("tokens") > F.col("context"))
             .groupBy("context").agg(F.min(F.struct("tokens", "docs_from", "tokens_from")).alias("m")))
    every = hist.agg(F.max(F.col("tokens_below") + F.col("tokens_from"))).scalar()
    lost = F.coalesce(F.col("m.tokens_from") - F.col("context") * F.col("m.docs_from"), F.lit(0))
    total = F.coalesce(every, F.lit(0))
    return lim.join(above, "context", "left").select(
        "context", total.alias("total_tokens"), (total - lost).alias("kept_tokens"), lost.alias("lost_tokens"),
        F.coalesce("m.docs_from", F.lit(0)).alias("docs_cut"))


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, tokens): the smallest length that at least ``share`` of the documents do not exceed."""
    s = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    upto = (F.col("docs_below") + F.col("n_docs")) / (F.col("docs_below") + F.col("docs_from"))
    return (hist.select("tokens", upto.alias("_u"), s.alias("share")).filter(F.col("_u") >= F.col("share"))
            .groupBy("share").agg(F.min("tokens").alias("tokens")))
