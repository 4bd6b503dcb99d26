"""F4 / F5 / F6 against brute-force loops written from the original semantics."""
import math

import numpy as np

from pyspark.sql import functions as F

from versekit.operators import filters as FL
from versekit.operators import stats as S
from versekit.sources import tables as TB

WORDS = ["sun", "moon", "star", "rain", "river", "stone", "field", "night", "light", "storm"]


def _docs():
    rows, i = [], 0
    for a, n in (("a1", 5), ("a2", 4)):
        for k in range(n):
            ws = ["common"] + [WORDS[(k * 3 + j * (1 + len(a) + k)) % len(WORDS)] for j in range(6 + k)]
            rows.append((i, "en", a, " ".join(ws[:4]) + "\n" + " ".join(ws[4:])))
            i += 1
    return rows


def _tokens(text):
    return [w for line in text.split("\n") if len(line) >= 5 for w in line.split()]


def test_tfidf_filter_bruteforce(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    dw = TB.doc_words(docs)
    counts = S.token_counts(dw)
    n = S.n_tracks(docs)
    idf_df = S.idf(counts, n)
    idx = TB.track_index(docs)
    sizes = idx.groupBy("genre", "artist").agg(F.count(F.lit(1)).alias("reg_size"))
    ta = S.tfidf_artist(counts, idf_df, TB.covered_tracks(idx, sizes), n)
    got = {r.doc_id: list(r.words) for r in FL.tfidf_filter(dw, counts, idf_df, ta).collect()}

    toks = {d: _tokens(t) for d, _, _, t in rows}
    N = len(rows)
    df = {}
    for ws in toks.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = {w: round(math.log(N / c), 4) for w, c in df.items()}
    mean_idf = float(np.mean(list(idf.values())))
    for art in ("a1", "a2"):
        ids = [d for d, _, a, _ in rows if a == art]
        tfs = {}
        for d in ids:
            ws = toks[d]
            for w in set(ws):
                tfs.setdefault(w, []).append(round(ws.count(w) / len(set(ws)), 4))
        tfidf = {}
        for w, vals in tfs.items():
            m = round(float(np.mean(vals)), 4)
            tfidf[w] = round(m * idf[w], 4) if idf[w] else round(m * math.log(N / len(ids)), 4)
        cut = np.percentile(list(tfidf.values()), 30)
        for d in ids:
            ws = toks[d]
            keep = [w for w in ws if ws.count(w) / len(set(ws)) * (idf[w] if idf[w] else mean_idf) > cut]
            if keep:
                assert got[d] == keep, (d, got[d], keep)
            else:
                assert d not in got


def test_outliers_and_extra_training(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    dw = TB.doc_words(docs)
    counts = S.token_counts(dw)
    n = S.n_tracks(docs)
    idx = TB.track_index(docs)
    sizes = idx.groupBy("genre", "artist").agg(F.count(F.lit(1)).alias("reg_size"))
    ta = S.tfidf_artist(counts, S.idf(counts, n), TB.covered_tracks(idx, sizes), n)
    vals = {}
    for r in ta.collect():
        vals.setdefault(r.artist, {})[r.word] = r.tfidf4 / 10000.0
    out = {r.artist: r for r in FL.tfidf_outliers(ta).collect()}
    for art, d in vals.items():
        v = list(d.values())
        hi, lo = np.percentile(v, 98), np.percentile(v, 2)
        removed = sum(1 for x in v if x > hi or x < lo)
        assert out[art].removed == removed and out[art].vocab == len(v)
    extra = {r.doc_id: list(r.words) for r in FL.extra_training_filter(dw, ta).collect()}
    for d, _, art, t in rows:
        assert extra[d] == [w for w in _tokens(t) if vals[art].get(w, 0) > 0.0299]


def test_drop_outliers_keeps_the_rest(spark):
    rows = [("g", "a", f"w{i}", v) for i, v in enumerate([1, 5, 5, 6, 7, 8, 9, 9, 10, 400])]
    ta = spark.createDataFrame(rows, "genre string, artist string, word string, tfidf4 long")
    kept = sorted(r.tfidf4 for r in FL.drop_outliers(ta).collect())
    v = np.array([r[3] for r in rows], dtype=float)
    hi, lo = np.percentile(v, 98), np.percentile(v, 2)
    assert kept == sorted(int(x) for x in v if lo <= x <= hi)
    s = FL.tfidf_outliers(ta).first()
    assert s.removed == len(rows) - len(kept) and s.removed_frac == round(s.removed / len(rows), 3)
