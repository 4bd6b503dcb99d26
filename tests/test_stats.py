"""tf / idf / artist tf-idf against a brute-force statement of the original semantics."""
import math

from pyspark.sql import functions as F

from versekit.operators import stats as S
from versekit.sources import tables as TB

DOCS = [
    (1, "en", "a1", "sun moon star\nsun sun rain"),
    (2, "en", "a1", "moon river\nsun"),
    (3, "en", "a1", "xx"),                     # empty track: counts in N
    (4, "en", "a2", "star sun\nriver river sun"),
    (5, "en", "a2", "sun dust"),
]


def r4(x):
    return math.floor(x * 10000 + 0.5)


def test_idf_and_artist_tfidf(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, lang string, source string, text string")
    dw = TB.doc_words(docs)
    counts = S.token_counts(dw)
    n = S.n_tracks(docs)
    idf = {r.word: r.idf4 for r in S.idf(counts, n).collect()}
    toks = {d: [w for line in t.split("\n") if len(line) >= 5 for w in line.split()] for d, _, _, t in DOCS}
    N = len(DOCS)
    df = {}
    for ws in toks.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    assert idf == {w: r4(math.log(N / c)) for w, c in df.items()}
    assert idf["sun"] == 0 or df["sun"] < N
    # every track covered: registry size = number of tracks per artist
    idx = TB.track_index(docs)
    sizes = idx.groupBy("genre", "artist").agg(F.count(F.lit(1)).alias("reg_size"))
    cov = TB.covered_tracks(idx, sizes)
    got = {(r.artist, r.word): r.tfidf4 for r in S.tfidf_artist(counts, S.idf(counts, n), cov, n).collect()}
    for art, ids in (("a1", [1, 2, 3]), ("a2", [4, 5])):
        tfs = {}
        for d in ids:
            ws = toks[d]
            for w in set(ws):
                tfs.setdefault(w, []).append((2 * ws.count(w) * 10000 + len(set(ws))) // (2 * len(set(ws))))
        for w, vals in tfs.items():
            m4 = (2 * sum(vals) + len(vals)) // (2 * len(vals))
            i4 = idf[w]
            want = (m4 * i4 + 5000) // 10000 if i4 else math.floor(m4 * math.log(N / len(ids)) + 0.5)
            assert got[(art, w)] == want, (art, w)


def test_track_index_tags(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, lang string, source string, text string")
    tags = {r.doc_id: r.dtag for r in TB.track_index(docs).collect()}
    assert tags == {1: "en_a1000", 2: "en_a1001", 3: "en_a1002", 4: "en_a2000", 5: "en_a2001"}
