"""Shaping of nested lyrics-site payloads (already landed as JSON) into flat tables.

The network client itself is not part of this library; these functions take
the landed records (schemas in FIXTURES.md) and produce the album, track,
registry and artist tables with explode / nested select / window, never by
iterating rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata
from ..functions import text as TX

ALBUM_SCHEMA = ("artid long, album struct<id long, name string, artist struct<name string>>, "
                "tracks array<struct<number int, song struct<id long, title string, url string>>>")
SEARCH_SCHEMA = "query string, hits array<struct<pos int, id long, name string>>"
FETCHED_SCHEMA = "artist string, song_id long, url string, text string"


def album_tracks(albums: DataFrame) -> DataFrame:
    """Per album {song_id: url}, track count, and the artist name (first of the artist's
    first three albums that carries one, else 'unk')."""
    w = Window.partitionBy("artid").orderBy("album.id")
    a = albums.withColumn("_i", F.row_number().over(w))
    name = (a.filter((F.col("_i") <= 3) & F.col("album.artist.name").isNotNull())
            .groupBy("artid").agg(F.min_by("album.artist.name", "_i").alias("artist")))
    t = a.select("artid", F.col("album.id").alias("albumid"), F.col("album.name").alias("title"),
                 F.explode_outer("tracks").alias("t"))
    # a song listed twice in an album has one entry, the url of its first listing; both count as tracks
    per_song = (t.groupBy("artid", "albumid", "title", F.col("t.song.id").alias("song"))
                .agg(F.min_by("t.song.url", F.struct("t.number", "t.song.url")).alias("url"), F.count("t").alias("n")))
    per = (per_song.groupBy("artid", "albumid", "title")
           .agg(F.map_from_entries(F.collect_list(F.when(F.col("song").isNotNull(), F.struct("song", "url")))).alias("songs"),
                F.sum("n").alias("n_tracks")))
    return per.join(name, "artid", "left").withColumn("artist", F.coalesce("artist", F.lit("unk")))


def clean_tracks(albums: DataFrame) -> DataFrame:
    """(albumid, number, song_id, title, url) per track."""
    t = albums.select(F.col("album.id").alias("albumid"), F.explode("tracks").alias("t"))
    return t.select("albumid", F.col("t.number").alias("number"), F.col("t.song.id").alias("song_id"),
                    F.col("t.song.title").alias("title"), F.col("t.song.url").alias("url"))


def album_summary(albums: DataFrame) -> DataFrame:
    """Albums per artist with their track counts."""
    return album_tracks(albums).select("artid", "artist", "albumid", "title", "n_tracks")


def album_text(tracks: DataFrame) -> DataFrame:
    """Per album, titles and lyrics concatenated in track order.

    ``tracks``: (albumid, number, title, text)."""
    s = F.array_sort(F.collect_list(F.struct("number", "title", "text")))
    return (tracks.groupBy("albumid").agg(s.alias("_t"))
            .select("albumid", F.array_join(F.transform("_t", lambda r: F.concat_ws("\n", r["title"], r["text"])),
                                            "\n").alias("album_text")))


def ingest_gate(fetched: DataFrame, suffix: str = "lyrics", min_chars: int = refdata.INGEST_MIN_CHARS,
                url_col: str = "url", text_col: str = "text", key: str = "artist", order: str = "song_id") -> DataFrame:
    """Keep a fetched track when its url ends with ``suffix`` and its text is longer than
    ``min_chars``; title = url without its first 19 and last 7 characters; the track
    ordinal counts kept tracks only."""
    kept = fetched.filter(F.col(url_col).endswith(suffix) & (F.length(text_col) > min_chars))
    title = F.expr(f"substring({url_col}, {refdata.TITLE_URL_PREFIX_CHARS + 1}, "
                   f"length({url_col}) - {refdata.TITLE_URL_PREFIX_CHARS + refdata.TITLE_URL_SUFFIX_CHARS})")
    from ..operators.ordinals import group_ordinal
    o = group_ordinal(kept, [key], order, "track_no")
    return (kept.join(o, [key, order]).withColumn("title", title)
            .withColumn("dtag", F.format_string("%s%03d", F.col(key), F.col("track_no"))))


def resolve_artist(searches: DataFrame) -> DataFrame:
    """First hit whose name equals the query, else the first hit; the query is
    tried as given, with a zero-width-space prefix, then in title case."""
    q = F.col("query")

    def ranked(h):
        rank = (F.when(h["name"] == q, 0).when(h["name"] == F.concat(F.lit("\u200b"), q), 1)
                .when(h["name"] == F.initcap(q), 2).otherwise(3))
        return F.struct(rank.alias("rank"), h["pos"].alias("pos"), h["id"].alias("id"), h["name"].alias("name"))

    # each search row is resolved from its own hits, so a repeated query does not mix them
    best = searches.select("query", F.array_min(F.transform("hits", ranked)).alias("h"))
    return best.select("query", F.col("h.id").alias("id"), F.col("h.name").alias("name"), (F.col("h.rank") < 3).alias("exact"))


def artist_record(info: DataFrame, genre: str) -> DataFrame:
    """Flattened artist record plus the corpus file name ``genre_<clean name>.lyr``."""
    cln = TX.file_safe_name(F.col("name"))
    return info.select(
        "id", "name", "url", "following", "verified",
        (F.col("img") if "img" in info.columns else F.lit(None).cast("string")).alias("img"),
        (F.col("artist_role") if "artist_role" in info.columns else F.lit(None).cast("string")).alias("artist_role"),
        F.lit(genre).alias("genre"), cln.alias("name_cln"),
        F.concat(F.lit(genre + "_"), cln, F.lit(".lyr")).alias("lyr_file"))
