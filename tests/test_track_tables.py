"""Shared track tables: what is exchanged, what is evaluated once, what is kept for the topic model."""

from pyspark.sql import functions as F

from versekit.functions import text as T
from versekit.plans import catalog
from versekit.plans.corpus import Corpus


def table(spark, folder, n, files):
    words = ["garden", "river", "stone", "evening", "walking", "quiet"]
    rows = [(i, " ".join(words[(i * k + k) % 6] for k in range(1, 9)) + f" rare{i}", "en", f"src{i % 3}", 60) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df.repartition(files).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pairs_of_tracks_and_words_are_not_exchanged(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # more splits than cores, as a large table has
    try:
        c = Corpus(spark, table(spark, tmp_path, 200, 2 * cores), persist="none")
        assert c.documents.rdd.getNumPartitions() >= cores
        plan = c.counts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
        got = {(r["doc_id"], r["word"]): r["cnt"] for r in c.counts.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {}
    for r in c.documents.collect():
        for w in r["text"].split():
            want[r["doc_id"], w] = want.get((r["doc_id"], w), 0) + 1
    # digits glued to a word at a line's end are cut
    assert got == {(d, "rare" if w.startswith("rare") else w): n for (d, w), n in want.items()}


def test_every_kind_of_space_separates_tokens(spark):
    text = "".join(f"word{c}" for c in T.WS_CHARS) + "word's  ain't"
    df = spark.createDataFrame([(text,), ("",), (None,), (" \t ",)], "t string")
    got = [r["w"] for r in df.select(T.clean_tokens("t", stops=[]).alias("w")).collect()]
    assert got[0] == ["word"] * len(T.WS_CHARS) + ["words", "aint"] and got[1:] == [[], None, []]
    assert df.select(T.split_ws(F.lit("a".join(T.WS_CHARS))).alias("w")).first()["w"] == ["a"] * (len(T.WS_CHARS) - 1)


def test_bags_of_the_topic_model_are_kept(spark, tmp_path):
    folder = table(spark, tmp_path, 90, 3)
    try:
        shares = catalog.word_topics(spark, folder).groupBy("doc_id", "word").agg(F.sum("share").alias("s")).collect()
        c = Corpus.shared(spark, folder)
        assert c._models["bow"].storageLevel.useMemory and c._models["bow"].columns == ["doc_id", "bow"]
        assert shares and all(0.7 < r["s"] < 1.000001 for r in shares)
    finally:
        Corpus.release_all()
