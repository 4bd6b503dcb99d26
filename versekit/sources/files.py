"""Corpus files: marker-delimited track files, registries, artist records, cleaned output.

File layout of a corpus folder: one text file per artist named
``<genre>_<artist>.lyr``; tracks are separated by a marker line that starts
with ``SONGBREAK``.  Every reader returns a fixed-schema DataFrame (no schema
inference); writers use Spark's partitioned writers, so a folder of any size
is read and written in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import refdata
from ..functions import text as TX
from ..session import keep_table, path_exists

ENDING = ".lyr"

ARTIST_INFO_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("following", T.LongType()),
    T.StructField("verified", T.BooleanType()), T.StructField("img", T.StringType()),
    T.StructField("artist_role", T.StringType()), T.StructField("genre", T.StringType()),
    T.StructField("name_cln", T.StringType()), T.StructField("lyr_file", T.StringType()),
])


def genre_from_file(name: Column) -> Column:
    """Text before the first '_' of the file name."""
    return F.substring_index(name, "_", 1)


def artist_from_file(name: Column) -> Column:
    """Text between the first '_' and the first '.' of the file name."""
    rest = F.expr("substring(_fn, instr(_fn, '_') + 1)")
    return F.substring_index(rest, ".", 1)


def _name(name: Column) -> Column:
    """A file's name as it is in its folder (Spark gives it as in a URI)."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def select_files(spark: SparkSession, folders: str | Sequence[str], include: str | Sequence[str] = "all", exclude: str | Sequence[str] = ()) -> list[str]:
    """The paths of the corpus files of the included genres, without excluded genres and artists.

    Folders are listed by genre pattern, so files of other genres are not even
    listed; excluded artists drop out by name, and nothing is opened.  Unknown
    genres among those to include raise; folders, other endings and names without a genre do not count.
    """
    from .tables import resolve_genres
    folders, drop = [folders] if isinstance(folders, str) else list(folders), {exclude} if isinstance(exclude, str) else set(exclude)
    genres = [g for g in resolve_genres(include) if g not in drop]
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in dict.fromkeys(f.rstrip("/") for f in folders):
        for genre in genres:
            pattern = jvm.org.apache.hadoop.fs.Path(f"{_literal(folder)}/{genre}_*{ENDING}")
            for st in pattern.getFileSystem(conf).globStatus(pattern) or ():
                artist = st.getPath().getName().split("_", 1)[1].split(".", 1)[0]
                if st.isFile() and artist not in drop:
                    found.append(st.getPath().toString())
    return sorted(found)


def read_selected(spark: SparkSession, folders: str | Sequence[str], include: str | Sequence[str] = "all", exclude: str | Sequence[str] = (), keep_tail: bool = False) -> DataFrame:
    """S6 with S1: the tracks of the selected files of several folders."""
    paths = select_files(spark, folders, include, exclude)
    if not paths:
        return spark.createDataFrame([], "genre string, artist string, file string, track_no long, text string")
    return read_tracks(spark, [_literal(p) for p in paths], keep_tail)


def _literal(path: str) -> str:
    """A path in which no character is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _offsets(records: DataFrame, start: str, length: int) -> DataFrame:
    """(file, block, before, n_file, ended, headed) — one narrow row per block of a file: records of the file before it,
    all records, whether the file ends with a separator, and whether it begins with a marker line."""
    last = F.max_by(F.col("size"), F.col("at"))
    blocks = records.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + length).alias("bytes"), last.alias("size"),
        F.min_by(F.startswith("value", F.lit(start)), F.col("at")).alias("headed"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    # what the records and their separators take, against the size: without a last separator the file is shorter (a byte order mark, if any, is not part of a record)
    rest = F.col("size") - F.sum("bytes").over(every)
    return blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("n_file"),
                         rest.isin(0, 3).alias("ended"), F.first("headed").over(every.orderBy("block")).alias("headed"))


def read_tracks(spark: SparkSession, path: str | list[str], keep_tail: bool = False) -> DataFrame:
    """(genre, artist, file, track_no, text) of every track in the corpus files.

    Text after the last marker is dropped (the original emits a track only on
    a marker) unless ``keep_tail``.  The marker that begins a line separates the
    reader's records, so a file of any size is read by as many tasks as it has
    splits and a record is a track.  A track's number is its place in its
    split (in the order of the split's rows) after the records of the splits before it, from
    one row per split.  An empty file has no track; lines end with a line feed.
    """
    start = refdata.TRACK_MARKER
    sep = "\n" + start
    rows = (spark.read.text(path, lineSep=sep)
            .select("value", F.col("_metadata.file_path").alias("file"), _name(F.col("_metadata.file_name")).alias("_fn"), F.col("_metadata.file_size").alias("size"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
    firsts = rows.groupBy("file", "block").agg(F.min("at").alias("first"))
    at = _offsets(rows, start, len(sep)).join(firsts, ["file", "block"])
    r = rows.drop("size").join(at, ["file", "block"]).withColumn("i", F.col("at") - F.col("first") + F.col("before"))
    value, top = F.col("value"), F.col("i") == 0
    line = F.instr("value", "\n")  # behind a separator stands the rest of the marker's line
    inner = F.when(line > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    closed = F.col("ended") | (F.col("i") < F.col("n_file") - 1)
    body = F.when(top & ~F.col("headed"), value).otherwise(inner)
    # the separator took the line feed before the marker, which ends the track's last line
    text = F.concat(body, F.when(closed & ((top & ~F.col("headed")) | (line > 0)), F.lit("\n")).otherwise(""))
    entry = lambda shift, t, ended: F.struct((F.col("i") + shift).alias("track_no"), t.alias("text"), ended.alias("closed"))
    shift = F.col("headed").cast("int")
    parts = F.array(entry(shift, text, closed),
                    # a file that begins with a marker has an empty first track, one that ends with a marker an empty tail
                    F.when(top & F.col("headed"), entry(F.lit(0), F.lit(""), F.lit(True))),
                    F.when(F.col("ended") & (F.col("i") == F.col("n_file") - 1), entry(shift + 1, F.lit(""), F.lit(False))))
    out = r.select("_fn", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("t"))
    if not keep_tail:
        out = out.filter("t.closed")
    return out.select(genre_from_file(F.col("_fn")).alias("genre"), artist_from_file(F.col("_fn")).alias("artist"),
                      F.col("_fn").alias("file"), F.col("t.track_no").cast("bigint").alias("track_no"), F.col("t.text").alias("text"))


def track_words(tracks: DataFrame, stops=None) -> DataFrame:
    """Cleaned tokens of file tracks (short lines skipped, as the track reader does)."""
    return tracks.withColumn("words", TX.document_tokens("text", stops)).withColumn(
        "dtag", F.format_string("%s%03d", "artist", "track_no"))


def tagged_docs(tracks: DataFrame) -> DataFrame:
    """Running integer tag across all files in (genre, artist, track) order."""
    from ..operators.ordinals import ordinal_after_groups
    return ordinal_after_groups(tracks, ["genre", "artist"], "track_no", "tag")


def read_lines(spark: SparkSession, path: str, split_words: bool = True) -> DataFrame:
    """Lines longer than the minimum, whole or whitespace split."""
    df = spark.read.text(path).filter(F.length("value") >= refdata.MIN_LINE_CHARS)
    return df.select(TX.split_ws("value").alias("tokens")) if split_words else df.select(F.col("value").alias("line"))


# --------------------------------------------------------------------------- registry

#: Entries of one registry line; an artist's registry is as many lines as it needs.
REGISTRY_BLOCK = 1000
REGISTRY_LINE = "struct<artist: string, tracks: array<struct<no: bigint, dtag: string, title: string>>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry lines -> (genre, artist, track_no, dtag, title).

    ``append_registry`` stores artist and ordinal with every entry.  A line of
    the original format, a JSON map {dtag: title} without them, follows the
    original rule: the last three characters of a tag are its ordinal.
    """
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"genre=([^/]+)", 1).alias("genre"), "value",
                                       F.from_json("value", REGISTRY_LINE).alias("l"))
    own = (raw.filter("l.tracks IS NOT NULL").select("genre", F.col("l.artist").alias("artist"), F.explode("l.tracks").alias("t"))
           .select("genre", "artist", F.col("t.no").alias("track_no"), "t.dtag", "t.title"))
    plain = (raw.filter("l.tracks IS NULL")
             .select("genre", F.explode(F.from_json("value", "map<string,string>")).alias("dtag", "title"))
             .select("genre", F.expr("substring(dtag, 1, length(dtag) - 3)").alias("artist"),
                     F.expr("try_cast(substring(dtag, -3) AS bigint)").alias("track_no"), "dtag", "title"))
    return own.unionByName(plain).withColumn("genre", F.when(F.col("genre") != "", F.col("genre")))


def append_registry(spark: SparkSession, entries: DataFrame, path: str) -> DataFrame:
    """Append (genre, artist, dtag, title) rows, skipping those already present (the
    duplicate check the original documents).  Returns what was added.

    A registry entry is a genre's, an artist's and a tag's: one tag may stand under
    several genres or artists.  The ordinal is the entry's ``track_no`` if it has that
    column, else the number behind the artist's name in the tag; a tag of
    another form has no ordinal (null) and is stored as well.  Lines hold at
    most ``REGISTRY_BLOCK`` entries.  Only a missing path counts as a first write.
    """
    bad = entries.filter(~F.col("genre").isin(refdata.GENRES)).limit(1).count()
    if bad:
        raise ValueError("unknown genre in registry entries")
    key = ["genre", "artist", "dtag"]
    new = entries.dropDuplicates(key)
    if path_exists(spark, path):
        old = read_registry(spark, path).select(*key).distinct()
        new = new.join(old, [new[c].eqNullSafe(old[c]) for c in key], "left_anti")
    # the rows to add are fixed before the folder they are compared with changes
    new = keep_table(new.select(*entries.columns), "registry")
    behind = F.when(F.startswith("dtag", "artist"), F.expr("try_cast(substring(dtag, length(artist) + 1) AS bigint)"))
    no = F.coalesce(F.col("track_no").cast("bigint"), behind) if "track_no" in entries.columns else behind
    per = (new.withColumn("no", no).groupBy("genre", "artist", F.floor(F.coalesce("no", F.pmod(F.xxhash64("dtag"), F.lit(1 << 40))) / REGISTRY_BLOCK).alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("no", "dtag", "title"))).alias("tracks")))
    per.select("genre", F.to_json(F.struct("artist", "tracks")).alias("value")).write.mode("append").partitionBy("genre").text(path)
    return new


# --------------------------------------------------------------------------- artist info

def save_artist_info(records: DataFrame, path: str) -> None:
    """Append artist records as JSON lines with the fixed schema."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in ARTIST_INFO_SCHEMA.fields]
    records.select(*cols).write.mode("append").json(path)


def read_artist_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIST_INFO_SCHEMA).json(path)


# --------------------------------------------------------------------------- writers

def save_text(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """One line per row."""
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def write_clean_corpus(tracks: DataFrame, path: str, min_chars: int = refdata.MIN_LINE_CHARS - 1) -> None:
    """Cleaned tracks (one cleaned line per used line) partitioned by genre and artist.

    The file cleaner skips a line only when it is shorter than 5 characters
    counting its newline, i.e. it keeps lines of 4+ visible characters (one
    fewer than the track reader)."""
    lines = tracks.select("genre", "artist", "track_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.filter(F.length("line") >= min_chars)
    out = lines.select("genre", "artist", "track_no", "line_no", TX.clean_string("line").alias("value"))
    # range partitioning keeps files in track order and splits a hot artist over several tasks
    keys = ["genre", "artist", "track_no", "line_no"]
    (out.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .select("genre", "artist", "value").write.mode("overwrite").partitionBy("genre", "artist").text(path))


# --------------------------------------------------------------------------- models

def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_lda(path: str):
    from pyspark.ml.clustering import LocalLDAModel
    return LocalLDAModel.load(path)


# --------------------------------------------------------------------------- stop words

def read_stop_file(spark: SparkSession, path: str, extra=None) -> DataFrame:
    """Stop words of a file (one per line, trimmed) united with the ad-hoc list, distinct."""
    extra = refdata.ADHOC_STOPS if extra is None else extra
    f = spark.read.text(path).select(F.trim("value").alias("word")).filter(F.col("word") != "")
    add = spark.createDataFrame([(w,) for w in dict.fromkeys(extra)], "word string")
    return f.unionByName(add).distinct()
