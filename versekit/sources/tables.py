"""Corpus tables derived from the driver's parquet tables.

Mapping: genre = ``documents.lang``, artist = ``documents.source``, one
document = one track.  Track ordinals are per (genre, artist) ordered by
``doc_id``; ``dtag`` = ``genre_artist`` + zero padded ordinal (``%03d`` grows
past 999 instead of truncating).  The registry of an artist is its documents
that have a row in ``labels``; the registry title is the first five raw words
of the document's first line.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata
from ..functions import text as T
from ..operators.ordinals import group_ordinal
from ..session import shuffle_partitions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned by ``key``: over the cores where its scan yields fewer splits
    than cores, else into no fewer partitions than the scan has or shuffles use.

    Partitioned by the track key itself, before any text is taken apart, later per-track
    aggregates and joins on the key find their rows in place: one exchange of the raw text
    stands for exchanges of (track, word) pairs, which are many times as large.  The cleaned
    tokens are cached with this partitioning, so no branch repeats the cleaning.
    """
    spark = df.sparkSession
    target, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(target if splits < target else max(splits, shuffle_partitions(spark)), key)


def dtag_col(genre: Column | str, artist: Column | str, ordinal: Column | str) -> Column:
    g, a, o = (F.col(x) if isinstance(x, str) else x for x in (genre, artist, ordinal))
    return F.format_string("%s_%s%03d", g, a, o)


def tracks_meta(documents: DataFrame) -> DataFrame:
    """(doc_id, genre, artist): the narrow projection every per-track join uses."""
    return documents.select("doc_id", F.col("lang").alias("genre"), F.col("source").alias("artist"))


def track_index(documents: DataFrame) -> DataFrame:
    """(genre, artist, doc_id, track_no, dtag) with exact per-artist ordinals."""
    meta = tracks_meta(documents)
    idx = group_ordinal(meta, ["genre", "artist"], "doc_id", "track_no")
    return idx.select("genre", "artist", "doc_id", F.col("track_no").cast("bigint").alias("track_no"),
                      dtag_col("genre", "artist", "track_no").alias("dtag"))


def doc_words(documents: DataFrame, stops: Iterable[str] | None = None) -> DataFrame:
    """One row per track: cleaned tokens in text order plus their counts (no shuffle)."""
    return (documents
            .select("doc_id", F.col("lang").alias("genre"), F.col("source").alias("artist"),
                    T.document_tokens("text", stops).alias("words"))
            .withColumn("ntok", F.size("words").cast("bigint"))
            .withColumn("uniq", F.size(F.array_distinct("words")).cast("bigint")))


def lines(documents: DataFrame, stops: Iterable[str] | None = None) -> DataFrame:
    """Used lines of each track with their tokens and an end-of-track flag."""
    n = refdata.MIN_LINE_CHARS
    d = documents.select("doc_id", F.col("lang").alias("genre"), F.col("source").alias("artist"),
                         F.split("text", "\n").alias("_ls"))
    # end-of-track flag without a window or join: the last used line of the track
    # is the largest index whose line is long enough, computed in-row.
    d = d.withColumn("_last", F.array_max(F.transform("_ls", lambda l, i: F.when(F.length(l) >= n, i))))
    raw = d.select("doc_id", "genre", "artist", "_last", F.posexplode("_ls").alias("line_no", "line"))
    return (raw.filter(F.length("line") >= n)
            .select("doc_id", "genre", "artist", F.col("line_no").cast("bigint").alias("line_no"), "line",
                    T.clean_tokens("line", stops).alias("tokens"),
                    (F.col("line_no") == F.col("_last")).alias("eot")))


def first_words(text: Column | str, n: int = 5) -> Column:
    first_line = F.substring_index(T._c(text), "\n", 1)
    return F.array_join(F.slice(T.split_ws(first_line), 1, n), " ")


def registry(documents: DataFrame, labels: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(genre, artist, dtag, doc_id, track_no, title) for registered tracks."""
    index = index if index is not None else track_index(documents)
    titles = documents.select("doc_id", first_words("text").alias("title"))
    reg = index.join(labels.select("doc_id"), "doc_id", "left_semi")
    return reg.join(titles, "doc_id").select("genre", "artist", "dtag", "doc_id", "track_no", "title")


def tracks_with_titles(documents: DataFrame, index: DataFrame, reg: DataFrame, tags: Iterable[str] | None = None) -> DataFrame:
    """S3: (dtag, title, n_lines, lyrics) of every track, or of the given tags; title null outside the registry.

    Tags are looked up in the index first, so only their tracks are cleaned."""
    if tags is not None:
        index = index.filter(F.col("dtag").isin(list(tags)))
        documents = documents.join(index.select("doc_id"), "doc_id", "left_semi")
    ln = lines(documents).select("doc_id", "line_no", F.array_join("tokens", " ").alias("cleaned"))
    per = (ln.groupBy("doc_id")
           .agg(F.count(F.lit(1)).alias("n_lines"),
                F.array_sort(F.collect_list(F.struct("line_no", "cleaned"))).alias("_l")))
    per = per.select("doc_id", "n_lines", F.array_join(F.transform("_l", lambda s: s["cleaned"]), " | ").alias("lyrics"))
    j = index.select("doc_id", "dtag").join(reg.select("doc_id", "title"), "doc_id", "left").join(per, "doc_id", "left")
    return j.select("dtag", "title", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
                    F.coalesce("lyrics", F.lit("")).alias("lyrics"))


def registry_sizes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(genre, artist, reg_size) — number of registered tracks per artist."""
    return (tracks_meta(documents).join(labels.select("doc_id"), "doc_id", "left_semi")
            .groupBy("genre", "artist").agg(F.count(F.lit(1)).alias("reg_size")))


def covered_tracks(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tracks whose ordinal is below the artist's registry size (the original's coverage rule)."""
    return (index.join(sizes, ["genre", "artist"])
            .filter(F.col("track_no") < F.col("reg_size"))
            .select("doc_id", "genre", "artist", "track_no", "dtag", "reg_size"))


def resolve_genres(gen) -> list[str]:
    """genre selection: 'all', one genre or a list; unknown genres raise ValueError."""
    if gen == "all":
        return list(refdata.GENRES)
    req = [gen] if isinstance(gen, str) else list(gen)
    bad = [g for g in req if g not in refdata.GENRES]
    if bad:
        raise ValueError(f"not a valid genre: {bad}")
    return req


def select_genres(tracks: DataFrame, genres: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """F1/JN4: tracks of the requested genres; ``allowed`` (artist table) restricts by
    membership with a left-semi join."""
    out = tracks.filter(F.col("genre").isin(genres))
    if allowed is not None:
        out = out.join(allowed.select("genre", "artist").distinct(), ["genre", "artist"], "left_semi")
    return out
