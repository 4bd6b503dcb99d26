"""Evaluation helpers: positional train/test split, correlations, analogy accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table
from .ordinals import average_rank, ordinal_after_groups


def split(index: DataFrame, every: int = 5, group=("genre", "artist"), within: str = "track_no") -> DataFrame:
    """Corpus-order ordinal of every track; every ``every``-th one (ordinal % every == 0)
    is a test track.  The ordinal is the group offset plus the in-group ordinal, so no task
    sorts the whole corpus."""
    j = ordinal_after_groups(index, list(group), within, "ordinal")
    return j.withColumn("is_test", (F.col("ordinal") % every) == 0)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, pearson, spearman); Spearman is Pearson on average ranks
    (ties share the mean rank), ranks from ``ordinals.average_rank``."""
    # the rank plans read the pairs several times: write them once
    df = keep_table(df.select(x, y), "pairs")
    r = average_rank(average_rank(df, x, "_rx"), y, "_ry")
    pear = df.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"))
    spear = r.agg(F.corr("_rx", "_ry").alias("s"))
    return pear.select("n", "pearson", spear.select("s").scalar().alias("spearman"))


def analogy_accuracy(answers: DataFrame, expected: DataFrame, section: str = "label", answer: str = "vec_id") -> DataFrame:
    """(section, n_questions, accuracy): share of a section's questions whose first answer is the expected one.

    ``answers``: (section, rank, answer); ``expected``: (section, expected).  A question without an answer counts as wrong."""
    first = answers.filter(F.col("rank") == 1).select(section, F.col(answer).alias("_got"))
    right = F.coalesce((F.col("_got") == F.col("expected")).cast("double"), F.lit(0.0))
    return (expected.join(first, section, "left").groupBy(section)
            .agg(F.count(F.lit(1)).alias("n_questions"), F.avg(right).alias("accuracy")))
