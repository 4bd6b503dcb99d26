"""S1/S4 on files that several tasks read, S8 on shared and odd tags."""
import os
import random
import re

import pytest

from versekit.sources import files as FS


def plain(text, keep_tail):
    """The tracks of one file by one regular expression over the whole text."""
    parts = re.split(r"^SONGBREAK[^\n]*(?:\n|\Z)", text, flags=re.M)
    return parts if keep_tail else parts[:-1]


def write(folder, texts):
    os.makedirs(folder)
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["file"], []).append((r["track_no"], r["text"]))
    return {f: [t for _, t in sorted(v)] for f, v in out.items() if [n for n, _ in sorted(v)] == list(range(len(v)))}


CASES = {
    "rock_Plain.lyr": "a\nb\nSONGBREAK\nc\nSONGBREAK\ntail\n", "rock_Headed.lyr": "SONGBREAK\nfirst\nSONGBREAK 2 of 3\nsecond\nSONGBREAK\n",
    "rock_NoMarker.lyr": "only a tail\n", "rock_EndsAtMarker.lyr": "a\nSONGBREAK", "rock_Twice.lyr": "a\nSONGBREAK\nSONGBREAK\nb\n\n\nSONGBREAK x\nSONGBREAK\n",
    "rap_OnlyMarker.lyr": "SONGBREAK\n", "rap_Bare.lyr": "SONGBREAK", "rap_Inner.lyr": "not SONGBREAK here\n SONGBREAK\nSONGBREAKING\nSONGBREAK\nx", "rap_Feed.lyr": "\nSONGBREAK\n\n\nSONGBREAK\n\n",
    "pop_Été.lyr": "Été à Paris\nnaïve\nSONGBREAK\n東京\nSONGBREAK\n", "pop_Text.lyr": "no break\nat the end\nSONGBREAK\nlast words"}


@pytest.mark.parametrize("keep_tail", [False, True])
@pytest.mark.parametrize("split", [None, 7, 64])
def test_equals_whole_files(spark, tmpdir_path, keep_tail, split):
    rng, folder = random.Random(5), os.path.join(tmpdir_path, "in")
    big = "".join(rng.choice(["SONGBREAK\n", "SONGBREAK and more\n", "a line of words\n", "\n", "SONG\n", "xSONGBREAK\n", "é" * rng.randint(1, 30) + "\n"]) for _ in range(400 if split else 4000))
    texts = {**CASES, "jazz_Big.lyr": big, "jazz_Headed.lyr": "SONGBREAK\n" + big, "jazz_Open.lyr": big + "open end"}
    write(folder, texts)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split or before)
    try:
        got = found(FS.read_tracks(spark, folder, keep_tail))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f: t for f, text in texts.items() if (t := plain(text, keep_tail))}


def test_large_file_is_read_by_several_tasks(spark, tmpdir_path):
    """One file of 200 MB: many splits, numbers as of the whole file, tags over files in order."""
    folder, song = os.path.join(tmpdir_path, "in"), "some words of a song\n" * 480
    os.makedirs(folder)
    with open(os.path.join(folder, "rock_Long.lyr"), "w") as f:
        for i in range(20_000):
            f.write(f"song {i}\n{song}SONGBREAK\n")
    write(os.path.join(folder, "x"), {"pop_Short.lyr": "a\nSONGBREAK\nb\nSONGBREAK\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        tracks = FS.read_tracks(spark, folder + "/*.lyr")
        assert spark.read.text(folder + "/*.lyr", lineSep="\nSONGBREAK").rdd.getNumPartitions() > 10
        bad = tracks.filter("text not like concat('song ', track_no, '\\n%') or length(text) != length(concat('song ', track_no, '\\n')) + 10080")
        assert tracks.count() == 20_000 and tracks.select("track_no").distinct().count() == 20_000 and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    tags = FS.tagged_docs(FS.read_tracks(spark, folder + "/x").unionByName(tracks.filter("track_no < 5"))).select("tag", "file", "track_no").orderBy("tag").collect()
    assert [(r["tag"], r["file"], r["track_no"]) for r in tags] == [(0, "pop_Short.lyr", 0), (1, "pop_Short.lyr", 1), *[(i + 2, "rock_Long.lyr", i) for i in range(5)]]


def test_registry_keys_and_tags(spark, tmpdir_path):
    path, kind = os.path.join(tmpdir_path, "reg"), "genre string, artist string, dtag string, title string"
    rows = [("rap", "ab", "ab000", "one"), ("pop", "ab", "ab000", "two"), ("pop", "b", "ab000", "three"), ("rock", "Band", "other", "no number"),
            ("rock", "Band", "Band", "no number either"), ("rock", "Band", "Band12x", "nor here"), ("rock", "Band", "Band1234", "long"), ("rap", "ab", "ab000", "one")]
    df = spark.createDataFrame(rows, kind)
    assert FS.append_registry(spark, df, path).count() == 7
    got = {(r["genre"], r["artist"], r["dtag"]): (r["track_no"], r["title"]) for r in FS.read_registry(spark, path).collect()}
    assert got == {("rap", "ab", "ab000"): (0, "one"), ("pop", "ab", "ab000"): (0, "two"), ("pop", "b", "ab000"): (None, "three"), ("rock", "Band", "other"): (None, "no number"),
                   ("rock", "Band", "Band"): (None, "no number either"), ("rock", "Band", "Band12x"): (None, "nor here"), ("rock", "Band", "Band1234"): (1234, "long")}
    assert FS.append_registry(spark, df, path).count() == 0
    more = spark.createDataFrame([("rock", "ab", "ab000", "four", 7), ("rap", "ab", "ab000", "again", 9)], kind + ", track_no long")
    assert [tuple(r) for r in FS.append_registry(spark, more, path).collect()] == [("rock", "ab", "ab000", "four", 7)]
    assert FS.read_registry(spark, path).filter("genre = 'rock' and artist = 'ab'").first()["track_no"] == 7
