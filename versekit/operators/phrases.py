"""Bigram phrases: counting, scoring, finding, applying and merging.

Scoring is the original bigram scorer of Mikolov et al. (2013):
``(n12 - min_count) * |vocab| / (n1 * n2)``, kept when above ``threshold``;
``|vocab|`` counts distinct unigrams plus distinct bigrams (the phrase
learner keeps both kinds of key in one vocabulary).

Bigrams are formed in-row from each sentence's token array (no window, no
shuffle); the counts are plain aggregates with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as S


def bigram_array(words: Column) -> Column:
    """Adjacent pairs of a token array as ARRAY<STRUCT<w1, w2>> (empty for < 2 tokens)."""
    n = F.size(words)
    return F.when(n >= 2, F.arrays_zip(F.slice(words, 1, n - 1).alias("w1"), F.slice(words, 2, n - 1).alias("w2"))) \
        .otherwise(F.array().cast("array<struct<w1:string,w2:string>>"))


def unigram_counts(sents: DataFrame, col: str = "words") -> DataFrame:
    return S.explode_words(sents, col=col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(sents: DataFrame, col: str = "words") -> DataFrame:
    b = sents.select(F.explode_outer(bigram_array(F.col(col))).alias("b")).filter(F.col("b").isNotNull())
    return b.select("b.w1", "b.w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n12"))


def score(uni: DataFrame, bi: DataFrame, min_count: int = 10, threshold: float = 10.0,
          delim: str = "-") -> DataFrame:
    """(w1, w2, phrase, n12, n1, n2, score) for bigrams scoring above threshold."""
    v = S.scalar(uni.agg(F.count(F.lit(1)))) + S.scalar(bi.agg(F.count(F.lit(1))))
    u1 = uni.select(F.col("word").alias("w1"), F.col("n").alias("n1"))
    u2 = uni.select(F.col("word").alias("w2"), F.col("n").alias("n2"))
    j = bi.filter(F.col("n12") > min_count).join(u1, "w1").join(u2, "w2")
    sc = ((F.col("n12") - min_count) * v).cast("double") / (F.col("n1") * F.col("n2")).cast("double")
    return (j.withColumn("score", sc).filter(F.col("score") > threshold)
            .select("w1", "w2", F.concat_ws(delim, "w1", "w2").alias("phrase"), "n12", "n1", "n2", "score"))


def find_phrases(test_sents: DataFrame, phrases: DataFrame, col: str = "words") -> DataFrame:
    """Distinct phrases of the model that occur in the test sentences, with scores."""
    tb = (test_sents.select(F.explode_outer(bigram_array(F.col(col))).alias("b")).filter(F.col("b").isNotNull())
          .select("b.w1", "b.w2").distinct())
    return tb.join(phrases, ["w1", "w2"]).select("phrase", "score")


def apply_phrases(sents: DataFrame, phrases: DataFrame, key: str, col: str = "words",
                  delim: str = "-") -> DataFrame:
    """Rewrite each sentence joining detected bigrams, greedily left to right.

    A position i is a candidate when (w_i, w_i+1) is a phrase.  Inside a run of
    consecutive candidates the greedy pass takes every second one starting at
    the run's first position.  Tokens meet the phrases in one join (which Spark sends to
    the tasks where they are few), then come together by sentence once: runs and
    the rewritten sentence are windows and an aggregate over that partitioning.
    """
    pos = sents.select(key, F.posexplode_outer(col).alias("pos", "word"), F.col(col).alias("_w"))
    pos = pos.withColumn("next", F.try_element_at("_w", (F.col("pos") + 2).cast("int"))).drop("_w")
    known = phrases.select(F.col("w1").alias("word"), F.col("w2").alias("next"), F.lit(True).alias("_is"))
    j = pos.join(known, ["word", "next"], "left").withColumn("_is", F.coalesce("_is", F.lit(False)))
    upto = Window.partitionBy(key).orderBy("pos")
    # the last position that is no candidate precedes the run's first
    j = j.withColumn("_before", F.coalesce(F.max(F.when(~F.col("_is"), F.col("pos"))).over(upto), F.lit(-1)))
    j = j.withColumn("_take", F.col("_is") & ((F.col("pos") - F.col("_before")) % 2 == 1))
    j = j.withColumn("_skip", F.coalesce(F.lag("_take").over(upto), F.lit(False)))
    tok = F.when(F.col("_take"), F.concat_ws(delim, "word", "next")).when(~F.col("_skip"), F.col("word"))
    out = j.select(key, F.when(tok.isNotNull(), F.struct(F.col("pos").alias("pos"), tok.alias("word"))).alias("t"))
    return (out.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("t"))
            .select(key, F.transform("t", lambda x: x["word"]).alias("words")))


def merge_counts(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Add the counts of new sentences to a model's counts (sum by key)."""
    val = [c for c in a.columns if c not in keys][0]
    return a.unionByName(b).groupBy(*keys).agg(F.sum(val).alias(val))


def phrase_list(phr: DataFrame) -> DataFrame:
    """(rank, phrase, score), the phrases by descending score, ties by phrase."""
    from .ordinals import ordinal_after_groups
    o = ordinal_after_groups(phr.select((-F.col("score")).alias("_s"), "phrase"), ["_s"], "phrase", "_o")
    return o.select((F.col("_o") + 1).cast("bigint").alias("rank"), "phrase", (-F.col("_s")).alias("score"))


def phrase_stats(phr: DataFrame) -> DataFrame:
    """Count, mean, median and population std of phrase scores (rounded to 6 places).

    The median is the mean of the middle rows of the ordered list, so no task holds all scores."""
    r6 = lambda c: (F.floor(c * 1e6 + 0.5) / 1e6)
    ordered, n = phrase_list(phr), F.count(F.lit(1))
    middle = ordered.agg(F.floor((n + 1) / 2).alias("lo"), F.floor(n / 2 + 1).alias("hi"))
    lo, hi = middle.select("lo").scalar(), middle.select("hi").scalar()
    median = ordered.filter(F.col("rank").between(lo, hi)).agg(F.avg("score")).scalar()
    return phr.agg(F.count(F.lit(1)).alias("n_phrases"), r6(F.avg("score")).alias("mean_score"),
                   r6(median).alias("median_score"), r6(F.stddev_pop("score")).alias("std_score"),
                   r6(F.max("score")).alias("max_score"))
