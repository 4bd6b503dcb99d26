"""Every stage of the pipeline against brute force on what its predecessor kept."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.conftest import HARD, sample
from tests.llm.test_forest import plain_components
from tests.llm.test_suffixes import plain_removal
from tests.llm.test_tokens import check_packing
from versekit.llm import quality
from versekit.llm.store import keep

SF = "/root/testdata/sf0.01"


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs.collect()]
    for name, stage in cp.STAGES:
        before = docs
        docs, _ = keep(stage(spark, docs, SF), "t")
        if name != cp.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
        steps.append(docs.collect())
    start, good, single, cut, clean, packed = steps
    kept = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert Counter(pairs(good)) == Counter((r["doc_id"], r["text"]) for r in start if r["doc_id"] in kept)
    assert 0.6 * len(start) < len(good) < len(start)
    heads = {d for d, _, c in plain_components(pairs(good), 5) if d == c}
    assert Counter(pairs(single)) == Counter(p for p in pairs(good) if p[0] in heads) and len(single) < len(good)
    want = {d: left.decode("utf-8", "replace").replace("�", "") for d, _, _, _, left in plain_removal(pairs(single), 100)}
    assert dict(pairs(cut)) == {d: t for d, t in want.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    bench = [b["text"] for b in sample("benchmark")]
    assert not any(b in t for _, t in pairs(clean) for b in bench) and len(clean) > 0.8 * len(cut)
    assert {d for d, _ in pairs(clean)} >= {d for d, t in pairs(cut) if not any(w in t for b in bench for w in [b[:60], b[-60:], b[len(b) // 3:len(b) // 3 + 60]])}
    n, least = check_packing(packed, pairs(clean), 2048)
    assert n <= least + 2


def test_hard_rows(spark, hard_docs, no_docs):
    for docs in (hard_docs, no_docs):
        docs, _ = keep(docs, "t")
        for _, stage in cp.STAGES:
            docs, _ = keep(stage(spark, docs, SF), "t")
    rows = spark.createDataFrame([(h[0], h[1], h[2], h[3], h[4]) for h in HARD], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_duplicates(spark, rows, SF).collect()
    texts = Counter(pairs(got))
    assert max(texts.values()) == 1 and {d for d, _ in texts} == {3, None, 9, 7, 1, 2, 8, 4, -6, 12}


def test_clean_documents_stay_beside_others_of_their_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    a, b, c = (" ".join(f"{x}{i * 7919 % 1000}" for i in range(80)) for x in ("ab", "cd", "ef"))
    rows = [(5, a), (5, b), (4, a), (None, a), (None, c), (6, c + " extra"), (7, item), (7, "clean"), (None, item), (None, "clean too")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(pairs(cp.near_duplicates(spark, docs, SF).collect())) == Counter([(4, a), (5, b), (6, c + " extra"), (7, "clean"), (None, "clean too"), (7, item)])
    assert Counter(pairs(cp.benchmark_leaks(spark, docs, SF).collect())) == Counter(r for r in rows if r[1] != item)


def test_run(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
