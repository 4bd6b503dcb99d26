"""Length histogram, packing and wavelet files against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import HARD, sample
from versekit.llm import encoding, lengths, packing, wavelet
from versekit.llm.store import shared_path


def plain(name, ordinary=False):
    """Ids by a tokenizer as the library loads it; ``ordinary``: special tokens' strings are text."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(encoding.tokenizer_path(name))
    if ordinary:
        t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TRICKY = ["", " ", "  ", "a b", " a", "a ", "a  b", "a \n b", "a  b", "x\t y", "'s it's", "été É́ ΑΣ ΑΣ. ΣΑ", "1 2  3", "\x1c a\x1d b",
          "tab\tand\r\nlines\n\n end  ", "<|endoftext|> <|startoftext|>", "a  <|endoftext|>  b<|endoftext|><|endoftext|> c", "<|endoftext|>", "it<|startoftext|>'s  ", "<|endoftext|", "<|EndOfText|> x", "é <|endoftext|> \n\n <|endoftext|>é",
          "😀 😀a", "a  b  c"]


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_library(name, words, monkeypatch):
    texts = [r["text"] for r in sample()][:300] + TRICKY + [h[1] for h in HARD]
    enc = encoding.Encoder(encoding.tokenizer_path(name), words)
    want = plain(name)(texts)
    assert [x.tolist() for x in enc.encode(texts)] == want
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 10)
    assert [x.tolist() for x in enc.encode(texts, 0)] == [w + [0] for w in want]


def test_words_are_remembered_without_their_signs(monkeypatch):
    enc = encoding.Encoder(encoding.tokenizer_path("byte_bpe_50k.json"), words=False)
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 10)
    calls, own = [], enc._plain
    enc._plain = lambda x: calls.append(x) or own(x)
    words = [f"wörd{a}{b}" for a in "abcdef" for b in "xyzuv"]
    for sign in (".", ",", "!?", ";"):
        texts = ["".join(f" {w}{sign}" for w in words), None, "", " ", "a\n \x0bx", "a \x0bx", "b <|endoftext|> c", "end ", "\u3000 \u3000x y"]
        assert [x.tolist() for x in enc.encode(texts, 0)] == [x + [0] for x in plain("byte_bpe_50k.json")(texts)]
    assert sum(len(x) > 4 for x in calls) == len(words)


def check_histogram(rows, sizes):
    c = Counter(sizes)
    assert {r["tokens"]: r["n_docs"] for r in rows} == dict(c)
    for r in rows:
        k = r["tokens"]
        assert r["docs_below"] == sum(n for x, n in c.items() if x < k)
        assert r["docs_from"] == sum(n for x, n in c.items() if x >= k)
        assert r["tokens_from"] == sum(x * n for x, n in c.items() if x >= k)
        assert r["kept_tokens"] == sum(min(x, k) * n for x, n in c.items())
        assert r["lost_tokens"] + r["kept_tokens"] == r["tokens_below"] + r["tokens_from"]


def test_length_histogram(spark, hard_docs, no_docs):
    rows = sample()
    sizes = [len(x) for x in plain("byte_bpe_50k.json", ordinary=True)([r["text"] for r in rows])]
    hist = lengths.length_histogram(spark.createDataFrame([(r["text"],) for r in rows], "text string")).cache()
    check_histogram(hist.collect(), sizes)
    for r in lengths.at_limits(hist, [1, 100, 777, 10**6]).collect():
        assert r["kept_tokens"] == sum(min(s, r["context"]) for s in sizes)
        assert r["docs_cut"] == sum(s > r["context"] for s in sizes)
    twice = lengths.at_limits(hist, [2, 2, 100]).collect()
    assert [r["context"] for r in sorted(twice)] == [2, 100] and {r["total_tokens"] for r in twice} == {sum(sizes)}
    assert all(r["lost_tokens"] == r["total_tokens"] - r["kept_tokens"] == sum(max(s - r["context"], 0) for s in sizes) for r in twice)
    got = {r["share"]: r["tokens"] for r in lengths.quantiles(hist, [0.1, 0.5, 1.0]).collect()}
    assert got == {q: sorted(sizes)[int(np.ceil(q * len(sizes))) - 1] for q in (0.1, 0.5, 1.0)}
    hard = [len(x) for x in plain("byte_bpe_50k.json", ordinary=True)([h[1] for h in HARD])]
    check_histogram(lengths.length_histogram(hard_docs).collect(), hard)
    assert lengths.length_histogram(no_docs).count() == 0
    assert lengths.at_limits(lengths.length_histogram(no_docs), [5]).first()["kept_tokens"] == 0


def check_packing(rows, docs, budget):
    ids = plain("word_bpe_49k.json")([t for _, t in docs])
    want = Counter()
    for (d, _), x in zip(docs, ids):
        x = np.array(x + [0], "<u4")
        for k in range(0, len(x), budget):
            want[d, k // budget, k, len(x[k:k + budget]), zlib.crc32(x[k:k + budget].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= budget
    least = -(-sum(r["length"] for r in rows) // budget)
    return len(seqs), least


def test_packing(spark, hard_docs, no_docs):
    rows = sample()
    docs = [(r["doc_id"], r["text"]) for r in rows]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    n, least = check_packing(got, docs, 2048)
    assert n <= least + 2
    n, least = check_packing(packing.pack(hard_docs, 64).collect(), [(h[0], h[1]) for h in HARD], 64)
    assert n <= least + 1
    assert packing.pack(no_docs).count() == 0


def test_best_two_fit_uses_every_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = dict(Counter(rng.integers(1, 101, size=int(rng.integers(1, 400))).tolist()))
        used = Counter()
        for times, pattern in packing.best_two_fit(counts, 100):
            assert times > 0 and sum(pattern) <= 100
            used.update({k: n * times for k, n in Counter(pattern).items()})
        assert used == counts
    # greedy takes 60 and 30; 20 + 20 in place of 30 fills the sequence
    assert packing.best_two_fit({60: 1, 30: 1, 20: 2}, 100)[0] == (1, [60, 20, 20])


def test_wavelet_file_answers():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (5, 3), (2000, 50), (3000, 60000), (700, 70000)):
        ids = (rng.zipf(1.3, n) % most).astype(np.uint32)
        ends = np.array([n // 2, n])
        f = wavelet.WaveletFile(wavelet.write_matrix(ids, np.array([4, 9]), ends))
        assert f.doc_ids.tolist() == [4, 9] and f.ends.tolist() == ends.tolist()
        for at in rng.integers(0, n, 20).tolist():
            assert f.access(at) == ids[at]
            assert f.count(int(ids[at]), at) == int((ids[:at] == ids[at]).sum())
            assert f.locate(int(ids[at]), int((ids[:at] == ids[at]).sum())) == at
        assert f.count(99999999) == 0
        assert (f.ids() == ids).all()


def check_wavelet(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] or ""))
    at, want = 0, []
    for (d, _), x in zip(docs, plain("byte_bpe_50k.json")([t for _, t in docs])):
        x = np.array(x + [0], "<u4")
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_wavelet_round_trip(spark, hard_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in sample()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    manifest = wavelet.write_shards(df, shared_path(spark, "w"), shard_bytes=300_000)
    assert manifest.count() > 3
    check_wavelet(wavelet.read_shards(manifest).collect(), docs)
    check_wavelet(wavelet.encode_and_read(hard_docs).collect(), [(h[0], h[1]) for h in HARD])
    assert wavelet.encode_and_read(no_docs).count() == 0
