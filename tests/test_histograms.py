"""A14-A16 histograms against numpy's histogram on 4-digit values."""
import numpy as np


from versekit.operators import stats as S


def test_histograms_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = {a: np.round(rng.gamma(2.0, 0.002, size=400), 4) for a in ("x", "y")}
    rows = [("g", a, float(v)) for a, vs in vals.items() for v in vs]
    df = spark.createDataFrame(rows, "genre string, artist string, v double")
    got = {(r.artist, r.bin): r.cnt for r in S.histogram(df, "v", 0.0006).collect()}
    for a, vs in vals.items():
        med, sd = np.median(vs), np.std(vs)
        hi = med + 3 * sd
        nb = int(round((hi - 0.0006) / 0.0002) + 2)
        counts, _ = np.histogram(vs, bins=nb, range=(0.0006, hi))
        for b, c in enumerate(counts):
            assert got.get((a, b), 0) == c, (a, b)
    mm = {(r.artist, r.bin): r.cnt for r in S.minmax_histogram(df, "v").collect()}
    for a, vs in vals.items():
        counts, _ = np.histogram(vs, bins=200, range=(vs.min(), vs.max()))
        for b, c in enumerate(counts):
            assert mm.get((a, b), 0) == c, (a, b)
    one = spark.createDataFrame([("g", "z", 0.5)] * 3, "genre string, artist string, v double")
    assert [(r.bin, r.cnt) for r in S.minmax_histogram(one, "v").collect()] == [(100, 3)]
