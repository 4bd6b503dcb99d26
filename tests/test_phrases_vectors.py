"""Greedy phrase application and exact vector top-k against brute force."""
import numpy as np

from versekit.operators import phrases as P
from versekit.operators import vectors as V


def py_apply(words, phrases, delim="-"):
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and (words[i], words[i + 1]) in phrases:
            out.append(words[i] + delim + words[i + 1])
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def test_apply_phrases(spark):
    sents = [(1, ["new", "york", "new", "york", "city"]), (2, ["a", "a", "a", "a", "a"]), (3, []), (4, ["new"])]
    phr = {("new", "york"), ("york", "city"), ("a", "a")}
    s = spark.createDataFrame(sents, "sid long, words array<string>")
    p = spark.createDataFrame(list(phr), "w1 string, w2 string")
    got = {r.sid: list(r.words) for r in P.apply_phrases(s, p, "sid").collect()}
    for sid, ws in sents:
        assert got[sid] == py_apply(ws, phr)


def test_top_k_similar_exact(spark):
    rng = np.random.default_rng(0)
    keys = rng.normal(size=(300, 8))
    qs = rng.normal(size=(5, 8))
    kdf = spark.createDataFrame([(i, keys[i].tolist()) for i in range(300)], "id long, v array<double>").repartition(4)
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(5)], "q long, v array<double>")
    got = V.top_k_similar(kdf, "id", "v", qdf, "q", "v", 7).collect()
    kn = keys / np.linalg.norm(keys, axis=1, keepdims=True)
    qn = qs / np.linalg.norm(qs, axis=1, keepdims=True)
    sims = qn @ kn.T
    for j in range(5):
        want = list(np.argsort(-sims[j], kind="stable")[:7])
        have = [r.id for r in sorted([r for r in got if r.q == j], key=lambda r: r.rank)]
        assert have == want


def test_relaxed_wmd_bruteforce(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    vecs = {w: rng.normal(size=5) for w in words}
    wv = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()], "word string, v array<double>")
    a = {"w0": 2.0, "w1": 1.0, "w2": 1.0}
    b = {"w3": 1.0, "w4": 3.0}
    rows = [(7, 0, w, x) for w, x in a.items()] + [(7, 1, w, x) for w, x in b.items()]
    pairs = spark.createDataFrame(rows, "pair long, side int, word string, w double")
    got = V.relaxed_wmd(pairs, "pair", "side", wv).first().rwmd
    u = {w: v / np.linalg.norm(v) for w, v in vecs.items()}
    def one(x, y):
        tot = sum(x.values())
        return sum(wx / tot * min(np.linalg.norm(u[k] - u[j]) for j in y) for k, wx in x.items())
    assert abs(got - max(one(a, b), one(b, a))) < 1e-12


def test_top_k_similar_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)   # forces several query blocks
    rng = np.random.default_rng(2)
    keys = rng.normal(size=(120, 6))
    qs = rng.normal(size=(9, 6))
    kdf = spark.createDataFrame([(i, keys[i].tolist()) for i in range(120)], "id long, v array<double>").repartition(3)
    qdf = spark.createDataFrame([(10 * j, qs[j].tolist()) for j in range(9)], "q long, v array<double>")
    got = V.top_k_similar(kdf, "id", "v", qdf, "q", "v", 4).collect()
    kn = keys / np.linalg.norm(keys, axis=1, keepdims=True)
    qn = qs / np.linalg.norm(qs, axis=1, keepdims=True)
    for j in range(9):
        want = list(np.argsort(-(qn[j] @ kn.T), kind="stable")[:4])
        have = [r.id for r in sorted([r for r in got if r.q == 10 * j], key=lambda r: r.rank)]
        assert have == want, j


def test_phrase_scores_bruteforce(spark):
    import random
    rnd = random.Random(4)
    vocab = ["new", "york", "city", "red", "wine", "blue", "sky", "a", "b", "c"]
    sents = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 12))] for _ in range(200)]
    sents += [["new", "york"]] * 30 + [["red", "wine", "now"]] * 25
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "sid long, words array<string>")
    got = {(r.w1, r.w2): (r.n12, r.score) for r in P.score(P.unigram_counts(df), P.bigram_counts(df), 10, 5.0).collect()}
    uni, bi = {}, {}
    for s in sents:
        for w in s:
            uni[w] = uni.get(w, 0) + 1
        for a, b in zip(s, s[1:]):
            bi[(a, b)] = bi.get((a, b), 0) + 1
    V_ = len(uni) + len(bi)
    want = {}
    for (a, b), n in bi.items():
        sc = (n - 10) * V_ / (uni[a] * uni[b])
        if n > 10 and sc > 5.0:
            want[(a, b)] = (n, sc)
    assert set(got) == set(want)
    for k, (n, sc) in want.items():
        assert got[k][0] == n and abs(got[k][1] - sc) < 1e-9


def test_apply_phrases_random(spark):
    import random
    rnd = random.Random(9)
    vocab = ["a", "b", "c", "d"]
    phr = {("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")}
    sents = [(i, [rnd.choice(vocab) for _ in range(rnd.randint(0, 15))]) for i in range(150)]
    s = spark.createDataFrame(sents, "sid long, words array<string>")
    p = spark.createDataFrame(list(phr), "w1 string, w2 string")
    got = {r.sid: list(r.words) for r in P.apply_phrases(s, p, "sid").collect()}
    for sid, ws in sents:
        assert got[sid] == py_apply(ws, phr), (ws, got[sid])


def test_top_k_ties_ids_and_nulls(spark, monkeypatch):
    from versekit.operators import vectors as V
    rng = __import__("random").Random(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 25 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(1000)]
    keys = spark.createDataFrame([*rows, (5000, None)], "k long, v array<double>").repartition(6)
    queries = spark.createDataFrame([("a", [2.0, 4.0, 6.0]), (None, [1.0, 2.0, 3.0]), ("none", None)], "q string, v array<double>")
    for block in (100_000, 90):
        monkeypatch.setattr(V, "KEY_BLOCK", block)
        got = V.top_k_similar(keys, "k", "v", queries, "q", "v", 5).collect()
        for q in ("a", None):
            assert [r["k"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [0, 25, 50, 75, 100]
        assert len(got) == 10
    names = keys.selectExpr("concat('n', lpad(k, 4, '0')) AS k", "v")
    many = spark.createDataFrame([(f"q{i}", [1.0, 2.0, 3.0]) for i in range(40)], "q string, v array<double>")
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    drop = spark.createDataFrame([("q3", "n0000"), ("q3", "n0050")], "q string, k string")
    got = V.top_k_similar(names, "k", "v", many, "q", "v", 3, exclude=drop).collect()
    assert len(got) == 120
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["q"], []).append(r["k"])
    assert by.pop("q3") == ["n0025", "n0075", "n0100"] and set(map(tuple, by.values())) == {("n0000", "n0025", "n0050")}


def test_relaxed_wmd_keeps_pairs_without_known_words(spark):
    from versekit.operators import vectors as V
    pairs = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 1.0), (2, 0, "zz", 1.0), (2, 1, "yy", 1.0), (3, 0, "a", 1.0), (3, 1, "yy", 1.0)],
                                  "pair long, side int, word string, w double")
    wv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, v array<double>")
    got = {r["pair"]: r["rwmd"] for r in V.relaxed_wmd(pairs, "pair", "side", wv).collect()}
    assert got.keys() == {1, 2, 3} and abs(got[1] - 2 ** 0.5) < 1e-12 and got[2] is None and got[3] is None


def test_sparse_top_k_by_both_ways(spark, monkeypatch):
    """Queries sent to every task and blocks of queries against blocks of tracks give the same rows as plain sums."""
    import random
    from versekit.operators import similarity as SIM
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    idf = spark.createDataFrame([(w, rng.choice([0, 5000, 12345, 30000])) for w in words], "word string, idf4 long")
    by = {r["word"]: r["idf4"] for r in idf.collect()}

    def bags(n, first):
        out = []
        for i in range(first, first + n):
            own = rng.sample(words, rng.randint(1, 12))
            out += [(i, len(own), w, rng.randint(1, 4)) for w in own]
        return out + [(first + n, *x[1:]) for x in out if x[0] == first]  # a copy of the first, for ties

    qs, ds = bags(9, 0), bags(80, 1000)
    kind = "uniq long, word string, cnt long"
    q, d = spark.createDataFrame(qs, "sid long, " + kind), spark.createDataFrame(ds, "doc_id long, " + kind)

    def weighed(rows):
        out = {}
        for k, uniq, w, c in rows:
            tf4 = (c * 20000 + uniq) // (2 * uniq)
            v = (tf4 * by[w] + 5000) // 10000
            if v > 0:
                out.setdefault(k, {})[w] = v
        return out

    qv, dv, want = weighed(qs), weighed(ds), []
    for a, x in qv.items():
        sims = []
        for b, y in dv.items():
            dot = sum(v * y.get(w, 0) for w, v in x.items())
            if dot:
                sims.append((-dot / ((sum(v * v for v in x.values()) ** 0.5) * (sum(v * v for v in y.values()) ** 0.5)), b))
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(sorted(sims)[:5])]
    for given in ({}, {"query_blocks": 3, "doc_blocks": 4}):
        got = sorted(tuple(r) for r in SIM.sparse_top_k(q, "sid", d, "doc_id", idf, 5, **given).collect())
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, sorted(want)))
    monkeypatch.setattr(SIM, "MOST_POSTINGS", 20)
    assert sorted(tuple(r) for r in SIM.sparse_top_k(q, "sid", d.repartition(5), "doc_id", idf, 5).collect()) == got
    assert SIM.sparse_top_k(q.limit(0), "sid", d, "doc_id", idf, 5).count() == 0 and SIM.sparse_top_k(q, "sid", d.limit(0), "doc_id", idf, 5).count() == 0
