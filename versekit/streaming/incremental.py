"""Incremental corpus updates with Structured Streaming.

ST1: new sentence files arrive in a folder; each micro-batch's unigram and
bigram counts are written as a partial count table keyed by ``batch_id``
(dynamic partition overwrite of that batch's partition, so a replayed batch
after a failure replaces itself instead of double counting).  Every ``fold_every``
batches the older partial tables are folded into one (``fold``), so that what
``merged_counts`` sums stays a few tables however long the stream runs.

ST2: new registry entries arrive as JSON lines; each batch is appended to the
registry with ordinals continuing after the artist's current maximum, which
Spark's state store holds (one number an artist), so a batch costs as much as its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as TX
from ..operators import phrases as P
from ..session import path_exists


def _write_partial(df: DataFrame, batch_id: int, out: str, kind: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(f"{out}/{kind}"))


KINDS = {"unigrams": (["word"], "n", "word string, n long"), "bigrams": (["w1", "w2"], "n12", "w1 string, w2 string, n12 long")}
#: Written last into a folded version: one without it is not there.
DONE = "_FOLDED"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix=<number>``; names alone are listed."""
    p, fs = _fs(spark, folder)
    found = (st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else ()
    return sorted(int(name[len(prefix) + 1:]) for name in found if name.startswith(prefix + "="))


def _folded(spark: SparkSession, out_dir: str) -> list[int]:
    """The last batches of all complete folded versions, the newest last."""
    return [n for n in _numbered(spark, f"{out_dir}/folded", "upto") if path_exists(spark, f"{out_dir}/folded/upto={n}/{DONE}")]


def _sums(spark: SparkSession, out_dir: str, kind: str, base: int, upto: int | None = None) -> DataFrame:
    """The newest folded version and the batches after it, up to ``upto`` if given, summed."""
    keys, value, schema = KINDS[kind]
    parts = spark.read.schema(schema + ", batch_id long").parquet(f"{out_dir}/{kind}").filter(F.col("batch_id") > base)
    parts = (parts if upto is None else parts.filter(F.col("batch_id") <= upto)).drop("batch_id")
    if base >= 0:
        parts = parts.unionByName(spark.read.schema(schema).parquet(f"{out_dir}/folded/upto={base}/{kind}"))
    return parts.groupBy(*keys).agg(F.sum(value).alias(value))


def fold(spark: SparkSession, out_dir: str, upto: int) -> None:
    """ST1: sum the folded version and all batches up to ``upto`` into a new version.

    A version counts once its last file is there; written again after a failure it
    is the same.  What the version before this one had folded is then deleted: readers that
    began before still find the tables they listed.  Batches up to a version are never
    read again, so one that is replayed after its fold changes nothing.
    """
    done = _folded(spark, out_dir)
    base = done[-1] if done else -1
    if upto <= base:
        return
    target = f"{out_dir}/folded/upto={upto}"
    for kind in KINDS:
        _sums(spark, out_dir, kind, base, upto).write.mode("overwrite").parquet(f"{target}/{kind}")
    p, fs = _fs(spark, f"{target}/{DONE}")
    fs.create(p, True).close()
    old = [f"{out_dir}/folded/upto={n}" for n in _numbered(spark, f"{out_dir}/folded", "upto") if n < base]
    old += [f"{out_dir}/{kind}/batch_id={n}" for kind in KINDS for n in _numbered(spark, f"{out_dir}/{kind}", "batch_id") if n <= base]
    for path in old:
        p, fs = _fs(spark, path)
        fs.delete(p, True)


def start_incremental_counts(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                             max_files_per_trigger: int = 100, fold_every: int = 16):
    """ST1: stream text files of sentences into per-batch partial count tables.

    Runs with ``availableNow`` (process what is there, then stop); returns the query.
    When ``fold_every`` batches wait, those before the current one (which are committed) are folded.
    """
    stream = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
              .load(in_dir))
    sents = stream.select(TX.document_tokens("value").alias("words"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        done = _folded(own, out_dir)
        base = done[-1] if done else -1
        if batch_id <= base:
            return  # replayed after it was folded
        cleaned = batch.persist()  # the text is cleaned once for both tables
        _write_partial(P.unigram_counts(cleaned), batch_id, out_dir, "unigrams")
        _write_partial(P.bigram_counts(cleaned), batch_id, out_dir, "bigrams")
        cleaned.unpersist()
        if batch_id - base > fold_every:
            fold(own, out_dir, batch_id - 1)

    return (sents.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def merged_counts(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unigram and bigram counts summed over every batch written so far."""
    done = _folded(spark, out_dir)
    base = done[-1] if done else -1
    return _sums(spark, out_dir, "unigrams", base), _sums(spark, out_dir, "bigrams", base)


REGISTRY_SCHEMA = "genre string, artist string, title string, seq long"
REGISTRY_TABLE = "genre string, artist string, track_no long, dtag string, title string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NextOrdinals(StatefulProcessor):
    """Numbers an artist's new rows after those numbered before; the state is the next number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.next.update((int(initialState["base"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["seq", "title"], kind="stable")  # an artist's rows of one batch
        base = self.next.get()[0] if self.next.exists() else 0
        self.next.update((base + len(new),))
        yield pd.DataFrame({"genre": new["genre"], "artist": new["artist"], "track_no": range(base, base + len(new)), "title": new["title"]})

    def close(self) -> None:
        pass


def start_registry_appends(spark: SparkSession, in_dir: str, registry_dir: str, checkpoint: str, max_files_per_trigger: int = 1000):
    """ST2: append streamed (genre, artist, title, seq) rows to a registry table.

    Ordinals continue after the artist's current maximum; within a batch they
    follow ``seq``, then ``title``.  The maxima are state (RocksDB, kept in the checkpoint), which
    the first batch takes from the registry, if there is one; later batches and
    restarts do not read it.  The batch writes its own ``batch_id`` partition (replay-safe:
    a batch that is run again starts from the state it started from before).
    """
    stream = spark.readStream.schema(REGISTRY_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(in_dir)
    if path_exists(spark, registry_dir):
        there = spark.read.schema(REGISTRY_TABLE).parquet(registry_dir)
    else:
        there = spark.createDataFrame([], REGISTRY_TABLE)
    start = there.groupBy("genre", "artist").agg((F.max("track_no") + 1).alias("base"))
    numbered = (stream.groupBy("genre", "artist").transformWithStateInPandas(
        statefulProcessor=NextOrdinals(), outputStructType="genre string, artist string, track_no long, title string",
        outputMode="Append", timeMode="None", initialState=start.groupBy("genre", "artist")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = batch.select("genre", "artist", "track_no", F.format_string("%s%03d", "artist", "track_no").alias("dtag"), "title")
        _write_partial(out, batch_id, registry_dir, "")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps the settings it was started with
    try:
        return (numbered.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run_to_completion(query) -> None:
    """Wait until an ``availableNow`` query has processed what is there; its failure is raised."""
    query.awaitTermination()
