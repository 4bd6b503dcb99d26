"""ST1 folding, ST2 state, S6 on folders."""
import json
import os
import re
from collections import Counter

import pytest

from versekit import refdata
from versekit.sources import files as FS
from versekit.streaming import incremental as ST


def sums(spark, out):
    uni, bi = ST.merged_counts(spark, out)
    return {r["word"]: r["n"] for r in uni.collect()}, {(r["w1"], r["w2"]): r["n12"] for r in bi.collect()}


def test_folds_bound_the_folders_and_replays_change_nothing(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    want_uni, want_bi = Counter(), Counter()
    for i in range(50):
        words = [f"word{'abcdefgh'[i % 8]}", "always", f"other{'xyz'[i % 3]}", "always"]
        with open(os.path.join(src, f"{i:02d}.txt"), "w") as f:
            f.write(" ".join(words) + "\n")
        want_uni.update(words)
        want_bi.update(zip(words, words[1:]))
    q = ST.start_incremental_counts(spark, src, out, ck, max_files_per_trigger=1, fold_every=6)
    ST.run_to_completion(q)
    assert q.lastProgress["batchId"] >= 49
    assert sums(spark, out) == (want_uni, want_bi)
    kinds = {k: sorted(x for x in os.listdir(os.path.join(out, k)) if "=" in x) for k in ("unigrams", "bigrams", "folded")}
    assert len(kinds["folded"]) <= 2 and all(len(kinds[k]) <= 14 for k in ("unigrams", "bigrams"))
    last = max(int(x.split("=")[1]) for x in kinds["folded"])
    # a batch that comes again after its fold, a fold that comes again, and one that did not reach its end
    spark.createDataFrame([("always", 1000)], "word string, n long").transform(lambda d: ST._write_partial(d, last - 1, out, "unigrams") or d)
    ST.fold(spark, out, last)
    os.makedirs(os.path.join(out, "folded", "upto=99", "unigrams"))
    assert sums(spark, out) == (want_uni, want_bi)
    ST.fold(spark, out, 49)
    assert sums(spark, out) == (want_uni, want_bi)
    with open(os.path.join(src, "50.txt"), "w") as f:
        f.write("always late\n")
    ST.run_to_completion(ST.start_incremental_counts(spark, src, out, ck, max_files_per_trigger=1, fold_every=6))
    uni, bi = sums(spark, out)
    assert uni == want_uni + Counter(["always", "late"]) and bi == want_bi + Counter([("always", "late")])


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(json.dumps(dict(zip(("genre", "artist", "title", "seq"), r))) + "\n" for r in rows)


def entries(spark, path):
    return sorted((r["genre"], r["artist"], r["track_no"], r["dtag"], r["title"]) for r in spark.read.parquet(path).collect())


def test_registry_state_survives_restarts_and_reads_no_registry(spark, tmpdir_path):
    src, reg, ck = (os.path.join(tmpdir_path, x) for x in ("in", "reg", "ck"))
    want, count = [], Counter()
    for i in range(4):  # every batch is a new query on the same checkpoint
        rows = [("rock", "A", f"a{i}{j}", 10 * i + j) for j in (2, 0, 1)] + [("rap", "A", f"r{i}", i)] + ([("rock", "B", "b", 5), ("rock", "B", "a", 5)] if i == 2 else [])
        put(src, f"{i}.json", rows)
        for g, a, t, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
            want.append((g, a, count[g, a], f"{a}{count[g, a]:03d}", t))
            count[g, a] += 1
        ST.run_to_completion(ST.start_registry_appends(spark, src, reg, ck))
        if i == 1:  # what was written is moved to another place: the numbers go on from the state
            os.rename(reg, reg + "-moved")
    assert sorted(entries(spark, reg) + entries(spark, reg + "-moved")) == sorted(want)


def test_registry_state_starts_from_a_registry(spark, tmpdir_path):
    src, reg = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "reg")
    put(src, "0.json", [("rock", "A", "one", 1), ("rock", "A", "two", 2), ("pop", "C", "c", 0)])
    ST.run_to_completion(ST.start_registry_appends(spark, src, reg, os.path.join(tmpdir_path, "ck1")))
    put(os.path.join(tmpdir_path, "in2"), "0.json", [("rock", "A", "three", 0), ("pop", "D", "d", 0)])
    ck = os.path.join(tmpdir_path, "ck2")
    spark.read.parquet(reg).select("genre", "artist", "track_no", "dtag", "title").write.parquet(reg + "2/batch_id=-1")
    ST.run_to_completion(ST.start_registry_appends(spark, os.path.join(tmpdir_path, "in2"), reg + "2", ck))
    assert [r for r in entries(spark, reg + "2") if r[1:3] in (("A", 2), ("D", 0))] == [("pop", "D", 0, "D000", "d"), ("rock", "A", 2, "A002", "three")]


def test_selected_files(spark, tmpdir_path):
    one, two = os.path.join(tmpdir_path, "one"), os.path.join(tmpdir_path, "two [x]")
    g = list(refdata.GENRES)
    names = {one: [f"{g[0]}_A.lyr", f"{g[0]}_B.lyr", f"{g[1]}_A.lyr", f"{g[1]}_C.lyr", f"{g[2]}_D.lyr", f"{g[0]}_E.txt", "none.lyr", "folk9_F.lyr"], two: [f"{g[0]}_G_H.v2.lyr", f"{g[1]}_I[1].lyr"]}
    for folder, files in names.items():
        os.makedirs(folder)
        for name in files:
            with open(os.path.join(folder, name), "w") as f:
                f.write(f"track of {name}\nSONGBREAK\n")
    os.makedirs(os.path.join(one, f"{g[0]}_Folder.lyr"))

    def chosen(*a, **b):
        return {os.path.basename(p) for p in FS.select_files(spark, *a, **b)}

    assert chosen(one) == {f"{g[0]}_A.lyr", f"{g[0]}_B.lyr", f"{g[1]}_A.lyr", f"{g[1]}_C.lyr", f"{g[2]}_D.lyr"}
    assert chosen([one, two, one], [g[0], g[1]], exclude="A") == {f"{g[0]}_B.lyr", f"{g[1]}_C.lyr", f"{g[0]}_G_H.v2.lyr", f"{g[1]}_I[1].lyr"}
    assert chosen(one, "all", [g[0], "D"]) == {f"{g[1]}_A.lyr", f"{g[1]}_C.lyr"} and chosen(one, g[2], g[2]) == set()
    with pytest.raises(ValueError):
        FS.select_files(spark, one, "no such genre")
    df = FS.read_selected(spark, [one, two], [g[0], g[1]], exclude=["A", "C"])
    opened = {re.sub("%5B", "[", re.sub("%5D", "]", os.path.basename(f))) for f in df.inputFiles()}
    assert opened == {f"{g[0]}_B.lyr", f"{g[0]}_G_H.v2.lyr", f"{g[1]}_I[1].lyr"}
    assert {(r["genre"], r["artist"], r["text"]) for r in df.collect()} == {
        (g[0], "B", f"track of {g[0]}_B.lyr\n"), (g[0], "G_H", f"track of {g[0]}_G_H.v2.lyr\n"), (g[1], "I[1]", f"track of {g[1]}_I[1].lyr\n")}
    assert FS.read_selected(spark, one, g[2], "D").count() == 0
