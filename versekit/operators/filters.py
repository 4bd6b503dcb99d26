"""Filters over the statistics: extremes, tf-idf cut-offs, outliers, rare words.

Percentile cut-offs are exact (``percentile``), evaluated on the integer
ten-thousandth values: the aggregate keeps one counter per distinct value,
so its memory is bounded by the value domain, not by the group size, and it
merges partial maps map-side — a hot artist does not land in one buffer.
The interpolated cut-off is recovered as an exact integer numerator
(``round(p * scale)``) so comparisons are integer comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata
from . import stats as S


def filter_extremes(counts: DataFrame, n_docs: Column, no_below: int = 30, no_above: float = 0.5) -> DataFrame:
    """(word, df) kept when df >= no_below and df <= no_above * #documents."""
    df = S.doc_freq(counts)
    return df.filter((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above) * n_docs))


def pct_numerator(value: Column, pct: int, scale: int) -> Column:
    """Exact ``scale * percentile(value, pct/100)`` for integer values (an integer)."""
    return F.round(F.percentile(value, pct / 100.0) * scale, 0).cast("bigint")


def artist_cutoffs(tfidf_artist: DataFrame, pct: int = refdata.TFIDF_CUTOFF_PCT) -> DataFrame:
    """(genre, artist, cut10): 10 x the pct-th percentile of the artist's tfidf4 values."""
    return tfidf_artist.groupBy("genre", "artist").agg(pct_numerator(F.col("tfidf4"), pct, 10).alias("cut10"))


def with_places(doc_words: DataFrame, values: DataFrame, *cols: str, key: str = "doc_id") -> DataFrame:
    """(key, word, at, *cols): the positions of each track's words that ``values`` (key, word, *cols; one row a pair) names.

    A track's values travel to it as one row, tracks as their token arrays; both are
    then taken apart and matched by word where they lie (the partitioning by
    track serves the grouping by track and word), so no token is exchanged.
    """
    per = values.groupBy(key).agg(F.collect_list(F.struct("word", *cols)).alias("_v"))  # at most one entry a distinct word
    kinds = {c: values.schema[c].dataType for c in cols}
    tokens = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]))
    named = F.transform("_v", lambda x: F.struct(x["word"].alias("word"), F.lit(-1).alias("pos"), *[x[c].alias(c) for c in cols]))
    rows = (doc_words.select(key, "words").join(per, key).select(key, F.explode(F.concat(tokens, named)).alias("x")).select(key, "x.*"))
    by = rows.groupBy(key, "word").agg(F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("at"), (F.min("pos") < 0).alias("_named"),
                                       *[F.max(c).alias(c) for c in cols])
    return by.filter("_named").drop("_named")


def in_order(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words): token arrays from (key, word, at)."""
    one = F.transform("at", lambda p: F.struct(p.alias("pos"), F.col("word").alias("word")))
    return (placed.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(one))).alias("_pw"))
            .select(key, F.transform("_pw", lambda s: s["word"]).alias("words")))


def tfidf_filter(doc_words: DataFrame, counts: DataFrame, idf_df: DataFrame, tfidf_artist: DataFrame,
                 pct: int = refdata.TFIDF_CUTOFF_PCT) -> DataFrame:
    """drop a word from a track when count/uniq * idf <= the artist's cut-off.

    The cut-off is the pct-th percentile of the artist's tf-idf values (0 for
    artists without them); words with idf 0 use the mean idf.  Returns
    (doc_id, words) for tracks that keep at least one word.
    """
    cut = artist_cutoffs(tfidf_artist, pct)
    sums = S.scalar(idf_df.agg(F.sum("idf4").alias("s")))
    nw = S.scalar(idf_df.agg(F.count(F.lit(1)).alias("n")))
    pairs = (counts.join(idf_df.select("word", "idf4"), "word", "left")
             .join(cut, ["genre", "artist"], "left")
             .withColumn("cut10", F.coalesce("cut10", F.lit(0))))
    # cnt/uniq * idf4/1e4 > cut10/1e5  <=>  10 * cnt * idf4 > cut10 * uniq   (exact integers)
    keep_idf = F.col("cnt") * F.col("idf4") * 10 > F.col("cut10") * F.col("uniq")
    mean = F.try_divide(sums.cast("double"), nw)
    keep_mean = F.col("cnt") * mean * 10 > (F.col("cut10") * F.col("uniq")).cast("double")
    keep = F.when(F.coalesce("idf4", F.lit(0)) != 0, keep_idf).otherwise(keep_mean)
    return in_order(with_places(doc_words, pairs.filter(keep).select("doc_id", "word")))


def _outlier_flags(tfidf_artist: DataFrame, lo: int, hi: int):
    b = tfidf_artist.groupBy("genre", "artist").agg(
        pct_numerator(F.col("tfidf4"), lo, 100).alias("lo100"),
        pct_numerator(F.col("tfidf4"), hi, 100).alias("hi100"),
        F.count(F.lit(1)).alias("vocab"))
    j = tfidf_artist.join(b, ["genre", "artist"])
    out = (F.col("tfidf4") * 100 > F.col("hi100")) | (F.col("tfidf4") * 100 < F.col("lo100"))
    return j, out


def drop_outliers(tfidf_artist: DataFrame, lo: int = refdata.OUTLIER_LO_PCT,
                  hi: int = refdata.OUTLIER_HI_PCT) -> DataFrame:
    """the artist tf-idf rows that remain after removing each artist's outliers."""
    j, out = _outlier_flags(tfidf_artist, lo, hi)
    return j.filter(~out).select(*tfidf_artist.columns)


def tfidf_outliers(tfidf_artist: DataFrame, lo: int = refdata.OUTLIER_LO_PCT,
                   hi: int = refdata.OUTLIER_HI_PCT) -> DataFrame:
    """per artist, values above the hi-th or below the lo-th percentile are removed.

    Returns (genre, artist, vocab, removed, removed_frac); ``drop_outliers``
    returns the remaining rows themselves."""
    j, out = _outlier_flags(tfidf_artist, lo, hi)
    per = j.groupBy("genre", "artist").agg(F.max("vocab").alias("vocab"),
                                           F.sum(F.when(out, 1).otherwise(0)).cast("bigint").alias("removed"))
    frac = S.idiv(F.col("removed") * 2000 + F.col("vocab"), F.col("vocab") * 2) / F.lit(1000.0)
    return per.withColumn("removed_frac", frac.cast("double"))


def extra_training_filter(doc_words: DataFrame, tfidf_artist: DataFrame, min_tfidf: float = refdata.EXTRA_TRAINING_MIN_TFIDF,
                          counts: DataFrame | None = None) -> DataFrame:
    """per track keep the words whose artist tf-idf exceeds ``min_tfidf``; a track without any keeps an empty array.

    ``counts``: the tracks' distinct words (genre, artist, doc_id, word), by default counted here; they alone meet the artists' words."""
    counts = S.token_counts(doc_words) if counts is None else counts
    thr4 = int(round(min_tfidf * S.TEN4))  # 0.0299 -> 299: tfidf > 0.0299 <=> tfidf4 > 299
    good = tfidf_artist.filter(F.col("tfidf4") > thr4).select("genre", "artist", "word")
    rebuilt = in_order(with_places(doc_words, counts.join(good, ["genre", "artist", "word"], "left_semi").select("doc_id", "word")))
    return (doc_words.select("doc_id").join(rebuilt, "doc_id", "left")
            .select("doc_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")))


def rare_words(word_artists: DataFrame, word_freq: DataFrame, n_artists: Column,
               share: float = refdata.RARE_ARTIST_SHARE, min_freq: int = refdata.RARE_MIN_FREQ) -> DataFrame:
    """words used by at most round(share * #artists) artists with frequency > min_freq."""
    limit = F.floor(n_artists * share + 0.5)
    return (word_artists.join(word_freq, "word")
            .filter((F.col("n_artists") <= limit) & (F.col("cnt") > min_freq)))
