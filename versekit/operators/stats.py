"""Corpus statistics: word frequency, tf, idf, tf-idf, bag of words, histograms.

Numbers follow the original's 4-digit rounding but are held as BIGINT
ten-thousandths (``*4`` columns) so that sums, means and products are exact
and identical in every engine; only ``idf4 = floor(ln(N/df)*1e4 + .5)`` and
the default-idf product touch floating point.  Output doubles are
``x4 / 10000.0``.

Plan shape (what each function costs at scale):
* ``token_counts`` — one exchange of distinct (track, word) pairs; the
  partial aggregate already sees whole tracks, so map-side combine is total.
* document frequency / artist aggregates — hash aggregates with partial
  aggregation; a hot word or hot artist is combined map-side.
* scalar corpus totals (N, mean idf) are scalar subqueries, not joins.
* top-k per artist uses ``row_number() <= k`` which Spark turns into a
  map-side WindowGroupLimit, so a hot artist ships only k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata

TEN4 = 10000


# --------------------------------------------------------------------------- fixed point

def idiv(a: Column, b: Column | int) -> Column:
    """Integer division (floor for the non-negative values used here)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def ratio4(k: Column, n: Column) -> Column:
    """round_half_up(k / n, 4) in ten-thousandths."""
    return idiv(k * (2 * TEN4) + n, n * 2)


def mean4(s: Column, c: Column) -> Column:
    """round_half_up(s / c) for s already in ten-thousandths."""
    return idiv(s * 2 + c, c * 2)


def mul4(a4: Column, b4: Column) -> Column:
    """round_half_up(a * b, 4) for two ten-thousandth values."""
    return idiv(a4 * b4 + TEN4 // 2, TEN4)


def log4(num: Column, den: Column) -> Column:
    """round(ln(num / den), 4) in ten-thousandths."""
    return F.floor(F.ln(num / den) * TEN4 + 0.5).cast("bigint")


def as_double(x4: Column) -> Column:
    return (x4 / F.lit(10000.0)).cast("double")


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column aggregate as a scalar subquery (no join)."""
    return df.scalar()


# --------------------------------------------------------------------------- base tables

def explode_words(df: DataFrame, *keep: str, col: str = "words", out: str = "word") -> DataFrame:
    """Explode a token array.  ``explode_outer`` + null filter on purpose: a plain
    ``explode`` lets Catalyst infer ``size(words) > 0`` and push it below the
    projection, which evaluates the whole cleaning expression twice."""
    return (df.select(*keep, F.explode_outer(col).alias(out))
            .filter(F.col(out).isNotNull()))


def token_counts(doc_words: DataFrame) -> DataFrame:
    """(doc_id, genre, artist, uniq, word, cnt): occurrences of each word in each track."""
    return (explode_words(doc_words, "doc_id", "genre", "artist", "uniq")
            .groupBy("doc_id", "genre", "artist", "uniq", "word")
            .agg(F.count(F.lit(1)).alias("cnt")))


def n_tracks(documents: DataFrame) -> Column:
    """Number of tracks including empty ones (they count in idf's numerator); a row without an id is no track."""
    return scalar(documents.agg(F.count("doc_id")))


# --------------------------------------------------------------------------- A1 / F2

def word_freq(doc_words: DataFrame, min_count: int = 3) -> DataFrame:
    """A1/F2: corpus word counts, words with count >= min_count."""
    return (explode_words(doc_words)
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
            .filter(F.col("cnt") >= min_count))


def word_freq_counts(counts: DataFrame, min_count: int = 3) -> DataFrame:
    """A1/F2 from the per-track counts (already combined per track: a smaller shuffle)."""
    return (counts.groupBy("word").agg(F.sum("cnt").alias("cnt"))
            .filter(F.col("cnt") >= min_count))


def corpus_counts(doc_words: DataFrame) -> DataFrame:
    """A2: per artist: tracks, raw tokens, empty tracks, sum of per-track distinct words."""
    return (doc_words.groupBy("genre", "artist")
            .agg(F.count(F.lit(1)).alias("n_tracks"),
                 F.sum("ntok").alias("n_tokens"),
                 F.sum(F.when(F.col("ntok") == 0, 1).otherwise(0)).cast("bigint").alias("n_empty"),
                 F.sum("uniq").alias("sum_uniq")))


def vocabulary_size(counts: DataFrame) -> DataFrame:
    """A2: distinct words before pruning and raw token total of the corpus."""
    per_word = counts.groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return per_word.agg(F.count(F.lit(1)).alias("n_words"), F.sum("cnt").alias("n_tokens"))


# --------------------------------------------------------------------------- A3 / A4 / A5

def track_tf(counts: DataFrame) -> DataFrame:
    """A3: tf4 = round(cnt / distinct words of the track, 4)."""
    return counts.withColumn("tf4", ratio4(F.col("cnt"), F.col("uniq")))


def artist_tf(counts: DataFrame, doc_words: DataFrame | None = None) -> DataFrame:
    """A4: Σ count of the word over the artist / Σ over tracks of distinct words (unrounded).

    Σ over tracks of distinct words = number of (track, word) rows of the artist,
    so both parts come from the per-track counts."""
    denom = counts.groupBy("genre", "artist").agg(F.count(F.lit(1)).alias("denom"))
    num = counts.groupBy("genre", "artist", "word").agg(F.sum("cnt").alias("cnt"))
    return (num.join(denom, ["genre", "artist"])
            .withColumn("tf", (F.col("cnt") / F.col("denom")).cast("double")))


def artist_words(counts: DataFrame) -> DataFrame:
    """A5: (genre, artist, word), the vocabulary of every artist."""
    return counts.select("genre", "artist", "word").distinct()


def word_artists(counts: DataFrame) -> DataFrame:
    """A5: number of artists using each word."""
    return (artist_words(counts)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_artists")))


# --------------------------------------------------------------------------- A6 / A7

def doc_freq(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def idf(counts: DataFrame, n_total: Column) -> DataFrame:
    """(word, df, idf4) with idf4 = round(ln(N / df), 4) in ten-thousandths."""
    return doc_freq(counts).withColumn("idf4", log4(n_total, F.col("df")))


def idf_mean4(idf_df: DataFrame) -> Column:
    """Mean idf in ten-thousandths as a DOUBLE scalar (Σ idf4 / #words)."""
    return scalar(idf_df.agg(F.try_divide(F.sum("idf4").cast("double"), F.count(F.lit(1))).alias("m")))


# --------------------------------------------------------------------------- A8 / A9 / A10

def tfidf_track(counts: DataFrame, idf_df: DataFrame, covered: DataFrame) -> DataFrame:
    """round(track tf * idf, 4) for registry-covered tracks; idf 0 -> mean idf."""
    m = idf_mean4(idf_df)
    tf = track_tf(counts.join(covered.select("doc_id", "dtag"), "doc_id"))
    j = tf.join(idf_df.select("word", "idf4"), "word", "left")
    val = F.when(F.coalesce(F.col("idf4"), F.lit(0)) != 0, mul4(F.col("tf4"), F.col("idf4"))) \
        .otherwise(F.floor(F.col("tf4") * m / TEN4 + 0.5).cast("bigint"))
    return j.select("genre", "artist", "dtag", "word", "tf4", val.alias("tfidf4"))


def tfidf_artist_simple(counts: DataFrame, doc_words: DataFrame, idf_df: DataFrame) -> DataFrame:
    """round(artist tf * idf4, 4); a zero idf stays zero."""
    atf = artist_tf(counts, doc_words)
    j = atf.join(idf_df.select("word", "idf4"), "word")
    val = F.floor(F.col("tf") * F.col("idf4") + 0.5).cast("bigint")
    return j.select("genre", "artist", "word", val.alias("tfidf4"))


def tfidf_artist(counts: DataFrame, idf_df: DataFrame, covered: DataFrame, n_total: Column) -> DataFrame:
    """A10: per artist and word, round(mean tf over covered tracks containing it, 4) * idf.

    Words whose idf is 0 use the artist's default idf ln(N / registry size).
    """
    tf = track_tf(counts.join(covered.select("doc_id", "reg_size"), "doc_id"))
    per = (tf.groupBy("genre", "artist", "word")
           .agg(F.sum("tf4").alias("s"), F.count(F.lit(1)).alias("c"), F.max("reg_size").alias("reg_size"))
           .withColumn("mtf4", mean4(F.col("s"), F.col("c"))))
    j = per.join(idf_df.select("word", "idf4"), "word", "left")
    default = F.floor(F.col("mtf4") * F.ln(n_total / F.col("reg_size")) + 0.5).cast("bigint")
    val = F.when(F.coalesce(F.col("idf4"), F.lit(0)) != 0, mul4(F.col("mtf4"), F.col("idf4"))).otherwise(default)
    return j.select("genre", "artist", "word", "mtf4", val.alias("tfidf4"))


# --------------------------------------------------------------------------- W2 top-k

def top_terms(tfidf: DataFrame, k: int = 10, value: str = "tfidf4",
              group=("genre", "artist")) -> DataFrame:
    """K highest values per group, ties broken by word."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), F.col("word").asc())
    return (tfidf.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


# --------------------------------------------------------------------------- A11 / A12 bag of words

def dense_vocab(words: DataFrame) -> DataFrame:
    """(word, term_id): dense ids in word order (bucketed ordinal, no single-task sort)."""
    from .ordinals import dense_rank_strings
    return dense_rank_strings(words, "word", "term_id")


def bow(counts: DataFrame, doc_words: DataFrame, min_count: int = 2, key=("genre", "artist")) -> DataFrame:
    """(key..., term_id, word, cnt) over words with corpus frequency >= min_count."""
    vocab_words = word_freq_counts(counts, min_count).select("word")
    vocab = dense_vocab(vocab_words)
    per = counts.groupBy(*key, "word").agg(F.sum("cnt").alias("cnt"))
    return per.join(vocab, "word").select(*key, "term_id", "word", "cnt")


# --------------------------------------------------------------------------- A13 cloud

def cloud_weights(counts: DataFrame, stops=(), min_len: int = refdata.CLOUD_MIN_WORD_LEN,
                  max_words: int = refdata.CLOUD_MAX_WORDS) -> DataFrame:
    """Word counts minus stops and short words, top ``max_words`` (count desc, word)."""
    c = counts.filter(F.length("word") >= min_len)
    stops = list(dict.fromkeys(stops))
    if stops:
        c = c.filter(~F.col("word").isin(stops))
    cnt = c.groupBy("word").agg(F.sum("cnt").alias("cnt"))
    # a global top-k: Spark plans TakeOrderedAndProject (k rows per task, then merge);
    # the rank window then runs over the k surviving rows only
    top = cnt.orderBy(F.col("cnt").desc(), F.col("word")).limit(max_words)
    w = Window.orderBy(F.col("cnt").desc(), F.col("word"))
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


# --------------------------------------------------------------------------- A14-A16 histograms

def hist_bounds(values: DataFrame, value: str, lo: float, key=("genre", "artist")) -> DataFrame:
    """Per group: median, population std, upper bound median + 3 std, bin count."""
    st = values.groupBy(*key).agg(F.median(value).alias("med"), F.stddev_pop(value).alias("sd"))
    hi = F.col("med") + F.col("sd") * 3
    nb = (F.round((hi - F.lit(lo)) / refdata.HIST_BIN_WIDTH, 0) + 2).cast("bigint")
    return st.withColumn("lo", F.lit(lo)).withColumn("hi", hi).withColumn("n_bins", nb)


def histogram(values: DataFrame, value: str, lo: float, key=("genre", "artist")) -> DataFrame:
    """Equal-width counts over [lo, median + 3 std] (numpy ``hist`` bin rule)."""
    # a group whose range is empty (upper bound <= lower bound) has no histogram
    b = hist_bounds(values, value, lo, key).filter(F.col("hi") > F.col("lo"))
    j = values.join(b, list(key))
    j = j.filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    raw = F.floor((F.col(value) - F.col("lo")) / width).cast("bigint")
    bin_ = F.least(raw, F.col("n_bins") - 1)
    return (j.withColumn("bin", bin_).groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("cnt")))


def minmax_histogram(values: DataFrame, value: str, bins: int = refdata.COMPARE_BINS,
                     key=("genre", "artist")) -> DataFrame:
    """``bins`` equal bins from each group's min to max (numpy rule: max in the last bin;
    a constant group uses [v - .5, v + .5])."""
    b = values.groupBy(*key).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))
    lo = F.when(F.col("mx") == F.col("mn"), F.col("mn") - 0.5).otherwise(F.col("mn"))
    hi = F.when(F.col("mx") == F.col("mn"), F.col("mx") + 0.5).otherwise(F.col("mx"))
    j = values.join(b.withColumn("lo", lo).withColumn("hi", hi), list(key))
    raw = F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("bigint")
    return (j.withColumn("bin", F.least(raw, F.lit(bins - 1)))
            .groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("cnt")))
