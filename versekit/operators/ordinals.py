"""Exact ordinals and ranks without funnelling a hot group into one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sorts a whole group in one
task.  Here the rows are range-partitioned by (group, key) into parts of about
``ROWS_PER_BUCKET`` rows - Spark takes the bounds from the keys themselves, so
far-off values, the full 64-bit range, shared string prefixes and clustered
doubles are cut alike - and sorted inside each part.  A row's place in its part
comes from ``monotonically_increasing_id``; the part counts of a group, summed
in order, complete the ordinal.  The placed rows are written once into the
shared folder: both readers see the same parts, also after an executor loss.

The only unpartitioned window runs over one row per part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep_table

ROWS_PER_BUCKET = 1_000_000


def placed(df: DataFrame, order: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    """``df`` with ``_part`` (range part in the given order) and ``_at`` (0-based place in the part)."""
    parts = max(1, -(-df.count() // (rows_per_bucket or ROWS_PER_BUCKET)))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id()
    return keep_table(ranged.select("*", F.shiftright(mono, 33).alias("_part"),
                                    mono.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordinals")


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> list:
    return [a[c].eqNullSafe(b[f"_g{i}"]) for i, c in enumerate(cols)]


def group_ordinal(df: DataFrame, group_cols: Sequence[str], order_col: str, out_col: str = "ordinal") -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order_col`` (nulls first).

    ``order_col`` must be unique inside a group and of an orderable type.
    Returns ``group_cols + [order_col, out_col]``; a null group is a group.
    """
    keys = [*group_cols, order_col]
    t = placed(df.select(*keys), keys)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if group_cols:
        before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*group_cols, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    blocks = blocks.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_part").alias("_p"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    on = [t["_part"] == blocks["_p"], *_same(t, blocks, group_cols)]
    return t.join(blocks, on).select(*keys, (F.col("_off") + F.col("_at") - F.col("_first")).cast("bigint").alias(out_col))


def dense_rank_strings(words: DataFrame, col: str = "word", out_col: str = "term_id") -> DataFrame:
    """Dense 0-based ids of distinct strings in binary order."""
    return group_ordinal(words.select(col).distinct(), [], col, out_col)


def ordinal_after_groups(df: DataFrame, group_cols: Sequence[str], within_col: str,
                         out_col: str = "ordinal") -> DataFrame:
    """``df`` with its global ordinal in (group_cols, within_col) order; that order is unique."""
    t = placed(df, [*group_cols, within_col])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    return t.join(sizes, "_part").withColumn(out_col, (F.col("_off") + F.col("_at")).cast("bigint")).drop("_off", "_part", "_at")


def average_rank(df: DataFrame, col: str, out_col: str, rows_per_bucket: int | None = None) -> DataFrame:
    """1-based average rank of ``col`` over all rows (ties share the mean of their positions).

    Works on the distinct values: (#rows with a smaller value) + (ties + 1) / 2.
    Cumulative counts run inside range parts of the distinct values, part
    offsets over one row per part.  Returns ``df`` plus ``out_col``.
    """
    t = placed(df.groupBy(col).agg(F.count(F.lit(1)).alias("_c")), [col], rows_per_bucket)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (t.groupBy("_part").agg(F.sum("_c").alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    fr = (t.withColumn("_less", F.coalesce(F.sum("_c").over(own), F.lit(0))).join(sizes, "_part")
          .select(F.col(col).alias("_v"), (F.col("_off") + F.col("_less") + (F.col("_c") + 1) / 2.0).alias(out_col)))
    return df.join(fr, df[col].eqNullSafe(fr["_v"])).drop("_v")
