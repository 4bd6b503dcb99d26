"""Values of the learned operators against numpy: E12, E18, E19, L2, L3, L4, L7, and the models' own tables."""
import numpy as np
from pyspark.sql import functions as F

from versekit.operators import models as M
from versekit.operators import topics as TP
from versekit.operators import vectors as V


def table(spark, m, name="v"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"id long, {name} array<double>")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((200, 6)) @ np.diag([5, 3, 1, 0.5, 0.4, 0.3]) + 2
    got = np.array([[r["pc1"], r["pc2"]] for r in M.pca_2d(table(spark, m), "id", "v").orderBy("id").collect()])
    _, s, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    for i in (0, 1):
        axis = vt[i] * (1 if vt[i][np.abs(vt[i]).argmax()] >= 0 else -1)
        np.testing.assert_allclose(got[:, i], m @ axis, atol=1e-8)  # MLlib projects without centring
    assert s[0] > s[1]


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(5)
    m = np.concatenate([c + 0.1 * rng.standard_normal((30, 4)) for c in 10 * np.eye(4)])
    got = [r["cluster"] for r in M.kmeans(table(spark, m), "id", "v", 4).orderBy("id").collect()]
    groups = [set(got[i * 30:(i + 1) * 30]) for i in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_relaxed_word_movers_distance_against_numpy(spark):
    rng = np.random.default_rng(7)
    words = {f"w{i}": rng.standard_normal(5) for i in range(12)}
    bags = [{s: {f"w{int(i)}": float(rng.integers(1, 4)) for i in rng.choice(14, 5, replace=False)} for s in (0, 1)} for _ in range(20)]
    bags.append({0: {"w12": 1.0}, 1: {"w1": 1.0}})  # no known word on one side
    rows = [(p, s, w, c) for p, b in enumerate(bags) for s in b for w, c in b[s].items()]
    wv = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in words.items()], "word string, v array<double>")
    got = {r["pair"]: r["rwmd"] for r in V.relaxed_wmd(spark.createDataFrame(rows, "pair long, side int, word string, w double"), "pair", "side", wv).collect()}
    for p, b in enumerate(bags):
        sides = [{w: c for w, c in b[s].items() if w in words} for s in (0, 1)]
        if not all(sides):
            assert got[p] is None
            continue
        u = {w: v / np.linalg.norm(v) for w, v in words.items()}
        one = [sum(c * min(np.linalg.norm(u[w] - u[x]) for x in b2) for w, c in a.items()) / sum(a.values()) for a, b2 in (sides, sides[::-1])]
        assert abs(got[p] - max(one)) < 1e-7  # distances of equal words are roots of rounding errors


def test_topic_tables_against_the_models_matrix(spark):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, [f"{'xyz'[i % 3]}{int(n)}" for n in rng.integers(0, 8, 30)]) for i in range(60)], "doc_id long, words array<string>")
    cv = TP.fit_dictionary(docs, 2, 60)
    bow = cv.transform(docs)
    m = TP.fit_lda(bow, 3, seed=5, max_iter=20)
    vocab, beta = TP.vocab_table(spark, cv), m.topicsMatrix().toArray()
    beta = beta / beta.sum(axis=0)
    assert sorted(r["word"] for r in vocab.collect()) == sorted({w for r in docs.collect() for w in r["words"]})
    terms = {}
    for r in TP.topic_terms(m, vocab, 5).collect():
        terms.setdefault(r["topic"], []).append((r["rank"], r["word"], r["weight"]))
    for k in range(3):
        best = np.sort(beta[:, k])[::-1][:5]
        rows = sorted(terms[k])
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        np.testing.assert_allclose([r[2] for r in rows], best, rtol=1e-9)
        np.testing.assert_allclose([beta[cv.vocabulary.index(r[1]), k] for r in rows], best, rtol=1e-9)
    wide = {r["topic"]: [r[f"w{i}"] for i in range(1, 6)] for r in TP.topic_terms_wide(TP.topic_terms(m, vocab, 5), 5).collect()}
    assert wide == {k: [w for _, w, _ in sorted(v)] for k, v in terms.items()}
    weights = {(r["topic"], r["word"]): r["weight"] for r in TP.term_weights(m, vocab).collect()}
    assert len(weights) == beta.size and all(abs(weights[k, w] - beta[i, k]) < 1e-12 for i, w in enumerate(cv.vocabulary) for k in range(3))
    mix = {r["doc_id"]: r["topics"].toArray() for r in m.transform(bow).collect()}
    rows = TP.topic_mixture(m, bow, "doc_id", 0.05).collect()
    assert {(r["doc_id"], r["topic"]) for r in rows} == {(d, k) for d, p in mix.items() for k in range(3) if p[k] >= 0.05}
    assert all(abs(r["weight"] - mix[r["doc_id"]][r["topic"]]) < 1e-12 for r in rows)
    assert {r["doc_id"]: r["topic"] for r in TP.doc_topics(m, bow, "doc_id").collect()} == {d: int(p.argmax()) for d, p in mix.items()}
    # the three groups of words are the three topics
    assert len({int(mix[i].argmax()) for i in range(3)}) == 3 and all(mix[i].argmax() == mix[i % 3].argmax() for i in range(60))


def test_mean_document_vectors_against_numpy(spark):
    rng = np.random.default_rng(2)
    wv = {f"w{i}": rng.standard_normal(4) for i in range(6)}
    rows = [(d, f"w{int(i)}", int(rng.integers(1, 9))) for d in range(10) for i in rng.choice(8, 4, replace=False)]
    vecs = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in wv.items()], "word string, v array<double>")
    got = {r["doc_id"]: r["v"] for r in M.weighted_doc_vectors(spark.createDataFrame(rows, "doc_id long, word string, w long"), "doc_id", vecs).collect()}
    for d in range(10):
        own = [(w, c) for k, w, c in rows if k == d and w in wv]
        np.testing.assert_allclose(got[d], sum(c * wv[w] for w, c in own) / sum(c for _, c in own), atol=1e-12)


def test_predicted_words_are_the_nearest(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((40, 6))
    q = rng.standard_normal((5, 6))
    got = V.top_k_similar(table(spark, m), "id", "v", table(spark, q).withColumnRenamed("id", "q"), "q", "v", 7).collect()
    u, x = m / np.linalg.norm(m, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    for i in range(5):
        own = sorted((r["rank"], r["id"]) for r in got if r["q"] == i)
        assert [k for _, k in own] == np.argsort(-(u @ x[i]))[:7].tolist()


def test_perplexity_follows_from_the_likelihood_without_a_second_inference(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, [f"w{int(n)}" for n in rng.integers(0, 9, 20)]) for i in range(30)] + [(99, ["rare"])], "doc_id long, words array<string>")
    bow = TP.fit_dictionary(docs, 2, 60).transform(docs)
    m = TP.fit_lda(bow, 3, seed=1, max_iter=5)
    want = m.logLikelihood(bow), m.logPerplexity(bow)
    monkeypatch.setattr(type(m), "logPerplexity", None)
    np.testing.assert_allclose(TP.likelihood(m, bow), want, rtol=1e-9)
