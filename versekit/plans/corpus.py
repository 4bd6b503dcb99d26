"""Lazily built base tables of one corpus (one sf directory).

Nothing here runs a job: every attribute is a DataFrame whose plan Catalyst
optimises when an action runs.  Re-used sub-plans (the token counts) appear
once per query plan and Spark re-uses their exchange.
"""

from __future__ import annotations

import hashlib
import os
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from ..sources import tables as TB


_SHARED: dict = {}


class Corpus:
    """Base tables of one corpus.  ``persist=True`` keeps the token tables
    (per-track token arrays and per-track word counts) at MEMORY_AND_DISK: a
    plan that reads them from several branches, and later queries of the same
    session, then clean the text once.  A lost cached block is recomputed
    from lineage, which is deterministic."""

    def __init__(self, spark: SparkSession, sf_dir: str, stops=None, persist: bool | str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.stops = stops
        # True / "memory": MEMORY_AND_DISK persist; "table": written parquet tables in the
        # shared checkpoint folder (cuts lineage, survives executor loss without recompute);
        # False: nothing kept.  Default from VERSEKIT_KEEP (memory).
        self._kept: list[DataFrame] = []
        self.persist = persist if persist is not None else os.environ.get("VERSEKIT_KEEP", "memory")

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Corpus":
        """One corpus per (running application, folder); a new session gets fresh tables."""
        key = (spark.sparkContext.applicationId, sf_dir)
        cur = _SHARED.get(key)
        if cur is None or cur.spark is not spark:
            cur = _SHARED[key] = cls(spark, sf_dir)
        return cur

    def _keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        if not self.persist or self.persist == "none":
            return df
        if self.persist == "table" and name:
            from ..session import ensure_checkpoint_dir
            tag = hashlib.sha1(f"{self.sf_dir}|{self.stops}".encode()).hexdigest()[:12]
            path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/versekit-{tag}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(kept)
        return kept

    def release(self) -> None:
        """Give back all persisted tables; they are built anew when next asked for."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        for name, attr in vars(type(self)).items():
            if isinstance(attr, cached_property):
                self.__dict__.pop(name, None)

    @classmethod
    def release_all(cls) -> None:
        """Give back the tables of every shared corpus of this process."""
        while _SHARED:
            _SHARED.popitem()[1].release()

    def table(self, name: str) -> DataFrame:
        return TB.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @cached_property
    def text_docs(self) -> DataFrame:
        """(doc_id, lang, source, text) partitioned by track, before any text is taken apart.

        The raw text is exchanged once; counts of (track, word) and joins by track then
        find their rows in place, where an exchange of the pairs would be many times the text.
        Only the text path is exchanged; narrow per-track columns are read directly.
        The explicit key filter equals the one joins on doc_id would infer, so
        every branch of a plan sees the same subtree."""
        return TB.spread(self.documents.select("doc_id", "lang", "source", "text")
                         .filter(F.col("doc_id").isNotNull()), "doc_id")

    @cached_property
    def _joined(self) -> DataFrame:
        """Cleaned tokens cached as one space-joined string per track: the in-memory
        columnar cache stores flat strings compactly and reads them back fast,
        while cached ARRAY<STRING> columns are slower to read than re-cleaning."""
        dw = TB.doc_words(self.text_docs, self.stops)
        return self._keep(dw.select("doc_id", "genre", "artist", "ntok", "uniq",
                                    F.array_join("words", " ").alias("joined")), "tokens")

    @cached_property
    def doc_words(self) -> DataFrame:
        """(doc_id, genre, artist, words, ntok, uniq) — tokens never contain a space."""
        j = self._joined
        words = F.when(F.col("ntok") > 0, F.split("joined", " ")).otherwise(F.array().cast("array<string>"))
        return j.select("doc_id", "genre", "artist", words.alias("words"), "ntok", "uniq")

    @cached_property
    def counts(self) -> DataFrame:
        return self._keep(S.token_counts(self.doc_words), "counts")

    @cached_property
    def index(self) -> DataFrame:
        """Track tags (one narrow row per track), kept because most queries join it."""
        return self._keep(TB.track_index(self.documents), "track_index")

    @cached_property
    def reg_sizes(self) -> DataFrame:
        return TB.registry_sizes(self.documents, self.labels)

    @cached_property
    def covered(self) -> DataFrame:
        return TB.covered_tracks(self.index, self.reg_sizes)

    @property
    def n_total(self):
        return S.n_tracks(self.documents)

    @cached_property
    def idf(self) -> DataFrame:
        return self._keep(S.idf(self.counts, self.n_total), "idf")

    @cached_property
    def tfidf_artist(self) -> DataFrame:
        return self._keep(S.tfidf_artist(self.counts, self.idf, self.covered, self.n_total), "tfidf_artist")

    @cached_property
    def unigrams(self) -> DataFrame:
        """Phrase-model unigram counts of the track corpus."""
        from ..operators import phrases as P
        return self._keep(P.unigram_counts(self.doc_words), "unigrams")

    @cached_property
    def bigrams(self) -> DataFrame:
        """Phrase-model bigram counts of the track corpus."""
        from ..operators import phrases as P
        return self._keep(P.bigram_counts(self.doc_words), "bigrams")
