"""LSH forest against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import HARD, sample
from versekit.llm import forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(docs, size, share=80):
    sets = [plain_set(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    both = Counter()
    for own in where.values():
        for i in range(len(own)):
            for j in range(i):
                both[own[j], own[i]] += 1
    for (i, j), n in both.items():
        if 100 * n >= share * (len(sets[i]) + len(sets[j]) - n):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


def run(spark, docs, size):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return Counter(map(tuple, forest.near_duplicates(df, size).collect()))


def test_sample(spark):
    docs = [(r["doc_id"], r["text"]) for r in sample()]
    assert run(spark, docs, 4) == plain_components(docs, 4)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**6)
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_chains_at_the_threshold(spark, seed, monkeypatch):
    rng = random.Random(seed)
    docs = []
    for g in range(12):  # dense groups of variants, and pairs about the threshold
        base = ["w%d" % rng.randrange(10**6) for _ in range(rng.choice([30, 80, 200]))]
        for k in range(rng.choice([2, 5, 60])):
            docs.append(edited(rng, base, rng.randrange(0, max(2, len(base) // 18))))
    chain = ["c%d" % i for i in range(300)]
    docs += [" ".join(chain[k * 12:k * 12 + 150]) for k in range(12)]
    docs += ["A b C", "a B c", "a b", "", None, "a b c d", "A B C D"] * 2
    rng.shuffle(docs)
    docs = [(i * 3, t) for i, t in enumerate(docs)]
    monkeypatch.setattr(forest, "SMALL", 9)
    monkeypatch.setattr(forest, "NEAR", 2)
    assert run(spark, docs, 4) == plain_components(docs, 4)


def test_large_group_below_the_threshold_writes_no_pairs(spark, monkeypatch):
    """400 variants that come near without a link, and a few that have one: the tables grow with the rows, not the pairs."""
    rng = random.Random(7)
    base = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    docs = [edited(rng, base, 7) for _ in range(400)]
    docs += [edited(rng, docs[k].split(), 3) for k in range(0, 400, 40)]
    docs = [(i, t) for i, t in enumerate(docs)]
    written, keep = {}, forest.keep

    def counted(df, label):
        out, path = keep(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out, path

    monkeypatch.setattr(forest, "SMALL", 9)
    monkeypatch.setattr(forest, "NEAR", 2)
    monkeypatch.setattr(forest, "keep", counted)
    assert run(spark, docs, 4) == plain_components(docs, 4)
    assert written["forest-rest"] > 0
    assert max(written.values()) <= (2 * forest.TREES + 1) * len(docs), written


def test_blocks_of_a_region_meet_each_other(spark, monkeypatch):
    """A group of many blocks, by rows and by bytes: each pair meets once."""
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    docs = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(150)]
    for name, value in (("SMALL", 9), ("NEAR", 1), ("BLOCK", 20), ("BLOCK_BYTES", 1 << 14)):
        monkeypatch.setattr(forest, name, value)
    assert run(spark, docs, 4) == plain_components(docs, 4)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))])
    sig = forest._signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.25


def test_hard_rows(spark, hard_docs, no_docs):
    got = Counter(map(tuple, forest.near_duplicates(hard_docs, 4).collect()))
    assert got == plain_components([(h[0], h[1]) for h in HARD], 4)
    assert forest.near_duplicates(no_docs).count() == 0
    empty = no_docs.sparkSession.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, forest.near_duplicates(empty).collect())) == [(1, 0, 1), (2, 0, 2)]
