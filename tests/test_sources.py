"""File readers/writers, payload shaping and streaming on inline fixtures."""
import json
import os


from versekit.sources import files as FS
from versekit.sources import payloads as PL


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_read_tracks_marker_and_tail(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "lyr")
    os.makedirs(d)
    _write(os.path.join(d, "rock_BandA.lyr"), "first line here\nabcd\nSONGBREAK\nsecond song words\nSONGBREAK\ntail text here\n")
    _write(os.path.join(d, "pop_SingerB.lyr"), "only song line\nSONGBREAK\n")
    tr = FS.read_tracks(spark, d)
    rows = sorted((r.genre, r.artist, r.track_no) for r in tr.collect())
    assert rows == [("pop", "SingerB", 0), ("rock", "BandA", 0), ("rock", "BandA", 1)]
    keep = FS.read_tracks(spark, d, keep_tail=True).filter("artist = 'BandA'").count()
    assert keep == 3
    w = {r.dtag: list(r.words) for r in FS.track_words(tr).collect()}
    assert w["BandA000"] == ["first", "line", "here"]          # 4-char line skipped
    tags = sorted(r.tag for r in FS.tagged_docs(tr).collect())
    assert tags == [0, 1, 2]


def test_registry_roundtrip_dedup(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "reg")
    e = spark.createDataFrame([("rock", "BandA", "BandA000", "Song One"), ("rock", "BandA", "BandA001", "Two")],
                              "genre string, artist string, dtag string, title string")
    FS.append_registry(spark, e, path)
    added = FS.append_registry(spark, e.union(spark.createDataFrame(
        [("rock", "BandA", "BandA002", "Three")], e.schema)), path)
    assert [r.dtag for r in added.collect()] == ["BandA002"]
    reg = FS.read_registry(spark, path)
    assert sorted(r.dtag for r in reg.collect()) == ["BandA000", "BandA001", "BandA002"]
    assert {r.track_no for r in reg.collect()} == {0, 1, 2}


def test_artist_info_and_clean_corpus(spark, tmpdir_path):
    info = spark.createDataFrame([(7, "The Band", "u", 10, True)], "id long, name string, url string, following long, verified boolean")
    rec = PL.artist_record(info, "rock")
    r = rec.first()
    assert r.lyr_file == "rock_TheBand.lyr" and r.img is None
    FS.save_artist_info(rec, os.path.join(tmpdir_path, "art"))
    back = FS.read_artist_info(spark, os.path.join(tmpdir_path, "art")).first()
    assert back.name_cln == "TheBand"
    tr = spark.createDataFrame([("rock", "BandA", 0, "Hello there world\nok\nrain\nThe end came")],
                               "genre string, artist string, track_no long, text string")
    out = os.path.join(tmpdir_path, "clean")
    FS.write_clean_corpus(tr, out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == ["end came", "hello world", "rain"]      # 4-char line kept, 2-char line skipped


def test_payload_shaping(spark):
    albums = spark.createDataFrame([
        (1, (10, "First", None), [(1, (100, "S1", "https://site.example/a-lyrics")), (2, (101, "S2", "u2"))]),
        (1, (11, "Second", ("Artist One",)), [(1, (102, "S3", "u3"))]),
    ], PL.ALBUM_SCHEMA)
    at = {r.albumid: r for r in PL.album_tracks(albums).collect()}
    assert at[10].artist == "Artist One" and at[10].n_tracks == 2 and at[10].songs[100].endswith("lyrics")
    assert PL.clean_tracks(albums).count() == 3
    fetched = spark.createDataFrame([
        ("A", 1, "https://site.test1/a-song-lyrics", "x" * 81),
        ("A", 2, "https://site.test1/b-song-lyrics", "x" * 80),
        ("A", 3, "https://site.test1/c-song-other", "x" * 200),
        ("A", 4, "https://site.test1/d-song-lyrics", "y" * 90)], PL.FETCHED_SCHEMA)
    g = sorted((r.song_id, r.track_no, r.title) for r in PL.ingest_gate(fetched).collect())
    assert g == [(1, 0, "a-song"), (4, 1, "d-song")]
    s = spark.createDataFrame([("abba", [(0, 5, "Abba Tribute"), (1, 6, "abba")]), ("x", [(0, 9, "y")]), ("none", [])],
                              PL.SEARCH_SCHEMA)
    res = {r.query: (r.id, r.exact) for r in PL.resolve_artist(s).collect()}
    assert res["abba"] == (6, True) and res["x"] == (9, False) and res["none"][0] is None
    txt = spark.createDataFrame([(10, 2, "T2", "b"), (10, 1, "T1", "a")], "albumid long, number int, title string, text string")
    assert PL.album_text(txt).first().album_text == "T1\na\nT2\nb"


def test_streaming_incremental_counts(spark, tmpdir_path):
    from versekit.streaming import incremental as ST
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    _write(os.path.join(src, "a.txt"), "new york city lights\nnew york again\n")
    _write(os.path.join(src, "b.txt"), "new york night\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    q = ST.start_incremental_counts(spark, src, out, ck, max_files_per_trigger=1)
    q.awaitTermination(120)
    uni, bi = ST.merged_counts(spark, out)
    d = {(r.w1, r.w2): r.n12 for r in bi.collect()}
    assert d[("new", "york")] == 3
    assert {r.word: r.n for r in uni.collect()}["york"] == 3


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "tfidf" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stop_file_and_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "stops.txt")
    _write(p, "alpha\nbeta \n\nha\n")
    words = {r.word for r in FS.read_stop_file(spark, p).collect()}
    assert {"alpha", "beta", "ha", "songbreak"} <= words and "" not in words
    lp = os.path.join(tmpdir_path, "l.txt")
    _write(lp, "one two three\nabc\nfour five\n")
    toks = [list(r.tokens) for r in FS.read_lines(spark, lp).collect()]
    assert toks == [["one", "two", "three"], ["four", "five"]]
    out = os.path.join(tmpdir_path, "saved")
    FS.save_text(spark.createDataFrame([("x y",)], "s string"), "s", out)
    assert [r.value for r in spark.read.text(out).collect()] == ["x y"]


def test_genre_selection(spark):
    import pytest
    from versekit.sources import tables as TB
    assert TB.resolve_genres("all")[0] == "rap" and TB.resolve_genres(["rock"]) == ["rock"]
    with pytest.raises(ValueError):
        TB.resolve_genres(["rock", "polka"])
    tr = spark.createDataFrame([("rock", "a"), ("rap", "b"), ("pop", "c")], "genre string, artist string")
    allowed = spark.createDataFrame([("rock", "a")], "genre string, artist string")
    assert TB.select_genres(tr, ["rock", "rap"], allowed).count() == 1


def test_registry_stream_appends(spark, tmpdir_path):
    from versekit.streaming import incremental as ST
    src = os.path.join(tmpdir_path, "regin")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        for i, t in enumerate(["T0", "T1", "T2"]):
            fh.write(json.dumps({"genre": "rock", "artist": "BandA", "title": t, "seq": i}) + "\n")
    reg, ck = os.path.join(tmpdir_path, "reg"), os.path.join(tmpdir_path, "ck2")
    ST.start_registry_appends(spark, src, reg, ck).awaitTermination(120)
    with open(os.path.join(src, "b.json"), "w") as fh:
        fh.write(json.dumps({"genre": "rock", "artist": "BandA", "title": "T3", "seq": 9}) + "\n")
    ST.start_registry_appends(spark, src, reg, ck).awaitTermination(120)
    got = sorted((r.track_no, r.title) for r in spark.read.parquet(reg).collect())
    assert got == [(0, "T0"), (1, "T1"), (2, "T2"), (3, "T3")]


def test_lda_save_load_and_album_summary(spark, tmpdir_path):
    from versekit.operators import topics as TP
    docs = spark.createDataFrame([(i, ["sun", "moon", "star", "rain"][i % 4:] + ["sky"]) for i in range(12)],
                                 "doc_id long, words array<string>")
    cv = TP.fit_dictionary(docs, 1, 1.0)
    m = TP.fit_lda(cv.transform(docs), k=2, max_iter=2, seed=1)  # explicit iteration count
    p = os.path.join(tmpdir_path, "lda")
    FS.save_model(m, p)
    back = FS.load_lda(p)
    assert back.vocabSize() == len(cv.vocabulary)
    albums = spark.createDataFrame([(1, (10, "A", ("X",)), [(1, (100, "S", "u"))])], PL.ALBUM_SCHEMA)
    assert PL.album_summary(albums).first().n_tracks == 1


def test_payload_fallbacks(spark):
    # No album among the first three carries an artist name -> 'unk'
    albums = spark.createDataFrame([(2, (20, "A", None), [(1, (200, "S", "u"))]),
                                    (2, (21, "B", None), [])], PL.ALBUM_SCHEMA)
    at = {r.albumid: r for r in PL.album_tracks(albums).collect()}
    assert at[20].artist == "unk" and at[21].n_tracks == 0
    # Exact name beats zero-width-prefixed name beats title case; else first hit
    hits = [(0, 1, "The Band Tribute"), (1, 2, "the band".title()), (2, 3, "\u200bthe band")]
    s = spark.createDataFrame([("the band", hits)], PL.SEARCH_SCHEMA)
    r = PL.resolve_artist(s).first()
    assert (r.id, r.exact) == (3, True)
    s2 = spark.createDataFrame([("the band", hits[:2])], PL.SEARCH_SCHEMA)
    assert PL.resolve_artist(s2).first().id == 2


def test_registry_past_999(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "reg1000")
    rows = [("rock", "Band9", f"Band9{i:03d}", f"t{i}") for i in range(1003)]
    e = spark.createDataFrame(rows, "genre string, artist string, dtag string, title string")
    FS.append_registry(spark, e, path)
    got = {r.dtag: (r.artist, r.track_no) for r in FS.read_registry(spark, path).collect()}
    assert got["Band91000"] == ("Band9", 1000) and got["Band9007"] == ("Band9", 7) and len(got) == 1003


def test_registry_second_append_past_999(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "reg2")
    schema = "genre string, artist string, dtag string, title string"
    first = [("rock", "ab", f"ab{i:03d}", f"t{i}") for i in range(1000)]
    later = [("rock", "ab", f"ab{i}", f"t{i}") for i in (1000, 1001, 1002)] + [("rock", "ab1", "ab1000", "other artist")]
    FS.append_registry(spark, spark.createDataFrame(first, schema), path)
    FS.append_registry(spark, spark.createDataFrame(later[:3], schema), path)
    got = {(r.artist, r.track_no): r.title for r in FS.read_registry(spark, path).collect()}
    assert got == {("ab", i): f"t{i}" for i in range(1003)}
    assert max(len(json.loads(r.value)["tracks"]) for r in spark.read.text(path).collect()) <= FS.REGISTRY_BLOCK


def test_registry_reads_the_original_format(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "old", "genre=rock")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.txt"), "w") as fh:
        fh.write(json.dumps({"ab000": "x", "ab001": "y"}) + "\n")
    got = sorted(tuple(r) for r in FS.read_registry(spark, os.path.dirname(folder)).collect())
    assert got == [("rock", "ab", 0, "ab000", "x"), ("rock", "ab", 1, "ab001", "y")]


def test_registry_read_error_is_raised(spark, tmpdir_path):
    import pytest
    path = os.path.join(tmpdir_path, "reg3")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.txt.gz"), "wb") as fh:
        fh.write(b"this is no gzip file")
    e = spark.createDataFrame([("rock", "A", "A000", "t")], "genre string, artist string, dtag string, title string")
    with pytest.raises(Exception, match="(?i)gzip"):
        FS.append_registry(spark, e, path)


def test_song_listed_twice_and_repeated_searches(spark):
    albums = spark.createDataFrame([(1, (10, "A", ("X",)), [(1, (100, "S", "u1")), (2, (100, "S", "u2")), (3, (101, "R", "v"))])], PL.ALBUM_SCHEMA)
    r = PL.album_tracks(albums).first()
    assert r.songs == {100: "u1", 101: "v"} and r.n_tracks == 3
    hits = spark.createDataFrame([("the x", [(0, 1, "other"), (1, 2, "The X")]), ("the x", [(0, 3, "nobody")]), ("none", [])], PL.SEARCH_SCHEMA)
    got = sorted(((r["query"], r["id"], r["exact"]) for r in PL.resolve_artist(hits).collect()), key=str)
    assert got == [("none", None, None), ("the x", 2, True), ("the x", 3, False)]


def test_lookup_by_tag(spark):
    from versekit.sources import tables as TB
    docs = spark.createDataFrame([(1, "en", "a", "first line here\nsecond line"), (2, "en", "a", "another text here")],
                                 "doc_id long, lang string, source string, text string")
    index = TB.track_index(docs)
    reg = TB.registry(docs, spark.createDataFrame([(2,)], "doc_id long"), index)
    got = TB.tracks_with_titles(docs, index, reg, ["en_a000"]).collect()
    assert [(r.dtag, r.title, r.n_lines) for r in got] == [("en_a000", None, 2)]
    assert {r.dtag: r.title for r in TB.tracks_with_titles(docs, index, reg).collect()} == {"en_a000": None, "en_a001": "another text here"}
