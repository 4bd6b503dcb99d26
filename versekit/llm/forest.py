"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct word shingles (a shorter text is one
shingle).  Equal sets are one node.  Each of ``TREES`` trees orders all nodes by the
same signature read in another order of its values; a label is the first
``DEPTH`` values of that order.  Nodes that share the first ``LEAST`` values form a
region.  Neighbours in the sorted order are candidates, ranked by their
common prefix: in a region of up to ``SMALL`` nodes all pairs are, in a denser one the
depth adapts - each node meets its ``NEAR`` next nodes, which there share the longest
prefixes.  Candidates that differ too much in set size are dropped exactly.

Links are confirmed on full sets: first every node's best candidate, then all
candidates that still lead to another component and whose signatures agree in
at least ``LOOSE`` of their values (far below the threshold: a pair at 0.8 falls
below with probability 5e-7).  What dense regions left uncompared is settled last: nodes outside a
region's largest component meet all its nodes, in blocks, by the same signature estimate; those
that come near a node of another component meet once more in these blocks, with full sets.  A pair
is compared in the first dense region it shares.  Neither step writes pairs: the first
passes rows on, the second yields the links that join components.

A pair at the threshold 0.8 shares no region with probability
(1 - 0.8^LEAST)^TREES = 3e-7.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a component's id is its smallest document id, null
ids aside; rows that repeat an id and a text get the same result each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versekit.llm.components import components
from versekit.llm.sketch import held, marked, write_repeated
from versekit.llm.store import discard, keep
from versekit.llm.textbuf import U64, Prefix, mix, slices, utf8, words

TREES, LEAST, DEPTH = 21, 3, 8
HASHES = TREES * LEAST
SMALL, NEAR, BLOCK = 33, 2, 2048
#: Bytes of full sets in a block.
BLOCK_BYTES = 64 << 20
LOOSE = 0.55
#: Fixed parameters of the hash functions: odd multipliers and offsets from a counter.
_A = mix(np.arange(1, HASHES + 1, dtype=U64)) | U64(1)
_B = mix(np.arange(1001, 1001 + HASHES, dtype=U64))
#: Tree t reads its own three values first, then the others from there on.
_ORDER = np.array([[(LEAST * t + k) % HASHES for k in range(DEPTH)] for t in range(TREES)])


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of every text (A-Z lower-cased)."""
    rows = len(off) - 1
    start, end, row = words(data, off)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    w = Prefix(low).slice(start, end)
    n = np.bincount(row, minlength=rows)
    h, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(w) >= size:
        at = np.flatnonzero(row[size - 1:] == row[:len(row) - size + 1])
        h = np.zeros(len(at), U64)
        for k in range(size):
            h = mix(h * U64(3) + w[at + k])
    owner = row[at] if len(at) else at
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first, own = np.searchsorted(row, short), np.zeros(len(short), U64)
        for k in range(size - 1):
            here = n[short] > k
            own[here] = mix(own[here] * U64(5) + w[first[here] + k])
        h, owner = np.concatenate([h, own + n[short].astype(U64)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def _fingerprints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    import xxhash
    raw, cut = h.tobytes(), (off * 8).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(cut, cut[1:])], U64).astype(np.int64)


def _signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, HASHES) least values; rows without shingles are left out."""
    full = off[:-1][off[1:] > off[:-1]]
    out = np.zeros((len(full), HASHES), np.uint32)
    if len(full):
        for i in range(HASHES):
            out[:, i] = np.minimum.reduceat(((h * _A[i] + _B[i]) >> U64(32)).astype(np.uint32), full)
    return out


def signed(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, sig) of every row; node and sig are null for an empty set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "t"):
                h, off = shingle_sets(*utf8(part.column("t")), size)
                n = np.diff(off)
                sig, at = _signatures(h, off), np.cumsum(n > 0) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), pa.array(n, pa.int64()), pa.array(_fingerprints(h, off), pa.int64(), mask=n == 0),
                     pa.array([sig[i].tobytes() if k else None for i, k in zip(at.tolist(), n.tolist())], pa.binary())],
                    names=["doc_id", "n_shingles", "node", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(
        run, "doc_id long, n_shingles long, node long, sig binary")


def _region_hashes(sig: np.ndarray) -> np.ndarray:
    """(nodes, TREES) hashes of the regions that nodes lie in."""
    out = np.zeros((len(sig), TREES), U64)
    for t in range(TREES):
        h = np.full(len(sig), t + 1, U64)
        for k in range(LEAST):
            h = mix(h * U64(11) + sig[:, _ORDER[t, k]])
        out[:, t] = h
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _labels(nodes: DataFrame) -> DataFrame:
    """(tree, label, node, n) of every node in every tree where its region holds other nodes; labels compare like their values."""
    sigs = nodes.select("sig", "node", "n_shingles")
    bitmap = write_repeated(sigs.select("sig"), lambda b: _region_hashes(_matrix(b.column("sig"))).ravel())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held(bitmap)
        for b in it:
            if not b.num_rows:
                continue
            sig = _matrix(b.column("sig"))
            shared = marked(bits, _region_hashes(sig))
            for t in range(TREES):
                own = np.flatnonzero(shared[:, t])
                raw = sig[own][:, _ORDER[t]].astype(">u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t, np.int32)), pa.array([raw[i:i + 4 * DEPTH] for i in range(0, len(raw), 4 * DEPTH)], pa.binary()),
                     b.column("node").take(pa.array(own)), b.column("n_shingles").take(pa.array(own))], names=["tree", "label", "node", "n"])

    return sigs.mapInArrow(run, "tree int, label binary, node long, n long")


def _neighbours(share: int):
    """Candidates among the sorted labels of one partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        tree, node, n = (t.column(c).to_numpy() for c in ("tree", "node", "n"))
        raw = t.column("label").to_pylist()
        lab = np.frombuffer(b"".join(raw), ">u4").reshape(-1, DEPTH)
        same = (lab[1:] == lab[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.cumprod(same, axis=1).sum(axis=1)  # with the next row
        region = np.concatenate([[0], np.cumsum(lcp < LEAST)])
        size = np.bincount(region)[region]
        common = np.full(len(node), DEPTH)
        for k in range(1, SMALL):
            m = len(node) - k
            if m <= 0:
                break
            common = np.minimum(common[:m], lcp[k - 1:])
            own = np.flatnonzero((region[:m] == region[k:]) & ((size[:m] <= SMALL) | (k <= NEAR)))
            if not len(own) and k > NEAR:
                break
            a, b = node[own], node[own + k]
            near = (100 * np.minimum(n[own], n[own + k]) >= share * np.maximum(n[own], n[own + k])) & (a != b)
            own, a, b = own[near], a[near], b[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(common[own].astype(np.int64)), pa.nulls(len(own), pa.binary())],
                                             names=["a", "b", "score", "region"])
        # regions may go on in the next partition, and dense ones are settled last: their first nodes stand for them
        ends = sorted({0, int(np.searchsorted(region, region[-1]))})
        yield pa.RecordBatch.from_arrays([pa.array(node[ends]), pa.nulls(len(ends), pa.int64()), pa.array(np.zeros(len(ends), np.int64)),
                                          pa.array([bytes([int(tree[i])]) + raw[i][:4 * LEAST] for i in ends], pa.binary())], names=["a", "b", "score", "region"])

    return run


def _pairs(labels: DataFrame, share: int) -> DataFrame:
    """(a, b, score): candidate pairs of nodes with the sum of their common prefixes over the trees."""
    spark = labels.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, _ = keep(labels.repartitionByRange(n, "tree", "label").sortWithinPartitions("tree", "label", "node")
                    .mapInArrow(_neighbours(share), "a long, b long, score long, region binary"), "forest-pairs")
    ends = found.filter("region IS NOT NULL")
    first = ends.groupBy("region").agg(F.min("a").alias("m"))
    chained = (ends.join(first, "region").filter("a != m")
               .select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"), F.lit(LEAST).cast("long").alias("score")))
    return (found.filter("region IS NULL").select("a", "b", "score").unionByName(chained)
            .groupBy("a", "b").agg(F.sum("score").alias("score")))


def _sets(docs: DataFrame, chosen: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(node, items): the full sets of nodes, from the documents that ``chosen`` (node, first) names."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([squeeze(t.encode()) for t in batch.column("t").to_pylist()], pa.binary())], names=["d", "z"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for batch in it:
            # one decompressor call per text; a batch of compressed texts is bounded like one of texts
            t = pa.array([zstandard.ZstdDecompressor().decompress(z) for z in batch.column("z").to_pylist()], pa.binary()).cast(pa.string())
            for part in slices(pa.RecordBatch.from_arrays([t, batch.column("w")], names=["t", "w"]), "t"):
                h, off = shingle_sets(*utf8(part.column("t")), size)
                raw, cut = h.tobytes(), (off * 8).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(h, off)), part.column("w"), pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                                                 names=["node", "want", "items"])

    packed = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(pack, "d long, z binary")
    wanted = packed.join(chosen.select(F.col("first").alias("d2"), F.col("node").alias("w")), F.col("d").eqNullSafe(F.col("d2")))
    got = wanted.select("z", "w").mapInArrow(run, "node long, want long, items binary").filter("node = want")
    return got.select("node", "items").dropDuplicates(["node"])


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in at least ``LOOSE`` of their values."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                ok = (_matrix(b.column("x")) == _matrix(b.column("y"))).sum(axis=1) >= LOOSE * HASHES
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (b.column("a"), b.column("b"))], names=["a", "b"])

    j = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
         .join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b"))
    return j.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b, linked) of every pair, by their full sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                p, q = (np.frombuffer(s.as_buffer(), U64) for s in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= share * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    j = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
         .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))
    return j.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _across(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if roots is None:
        return pairs
    j = (pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left")
         .join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left"))
    return j.filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).drop("_ra", "_rb")


def _blocks(rows: str, shingles: str) -> Column:
    """Blocks that hold at most ``BLOCK`` rows and about ``BLOCK_BYTES`` of sets."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(shingles) * 8 / BLOCK_BYTES, F.lit(1)))


def _left_over(labels: DataFrame, nodes: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """Rows of dense regions that the trees' orders left uncompared and whose signatures come near one of another component.

    Members outside a region's largest component (``stray``), against all members
    of other components, in blocks.  ``side`` is 0 for a stray that meets, 1 for a member that is met.
    """
    region = F.concat(F.col("tree").cast("string").cast("binary"), F.substring("label", 1, 4 * LEAST))
    rows = labels.select(region.alias("region"), "tree", "node", "n")
    dense = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SMALL)
    inside = (rows.join(dense.select("region"), "region").join(roots, "node", "left")
              .select("region", "tree", "node", "n", F.coalesce("root", "node").alias("comp")))
    inside, path = keep(inside, "forest-dense")
    per = inside.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = per.groupBy("region").agg(F.max(F.struct("c", "comp", "s")).alias("t"), F.count(F.lit(1)).alias("comps"),
                                    F.sum("c").alias("m"), F.sum("s").alias("s")).filter("comps > 1")
    top = top.select("region", F.col("t.comp").alias("main"), _blocks("m", "s").alias("right"),
                     F.col("m").alias("_m"), F.col("s").alias("_s"), (F.col("m") - F.col("t.c")).alias("lm"), (F.col("s") - F.col("t.s")).alias("ls"))
    top = top.select("region", "main", "right", _blocks("lm", "ls").alias("left"))
    members = inside.join(top, "region").withColumn("stray", F.col("comp") != F.col("main")).drop("main")
    trees = members.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("trees"))
    members, members_path = keep(members.join(trees, "node").join(nodes.select("node", "sig"), "node"), "forest-members")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = ["region", "tree", "node", "n", "comp", "stray", "trees", "sig"]
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    strays = members.filter("stray").select(*own, at("left").alias("l"), upto("right").alias("r"))
    others = members.select(*own, upto("left").alias("l"), at("right").alias("r"))
    schema = "region binary, tree int, node long, n long, comp long, stray boolean, trees long, sig binary, l long, r long"

    def near(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        met, meets = np.zeros(len(right), bool), np.zeros(len(left), bool)
        for i, alike in _alike(left, right, share):
            hit = alike(right["comp"].to_numpy() != left["comp"].iat[i])
            met[hit] = True
            meets[i] = len(hit) > 0
        return pd.concat([left[meets].assign(side=0), right[met].assign(side=1)])

    met = strays.groupBy("region", "l", "r").cogroup(others.groupBy("region", "l", "r")).applyInPandas(near, schema + ", side int")
    out, _ = keep(met, "forest-rest")
    discard(labels.sparkSession, path, members_path)
    return out


def _alike(left: pd.DataFrame, right: pd.DataFrame, share: int) -> Iterator[tuple[int, Callable[[np.ndarray], np.ndarray]]]:
    """For every row of ``left`` its number and a function: the rows of ``right`` among a choice whose sizes and signatures come near.

    Two strays meet once, and rows that share dense regions of several trees meet in the first.
    """
    if not len(left) or not len(right):
        return
    s, m = (np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(-1, HASHES) for x in (left, right))
    tree = int(left["tree"].iat[0])
    before = (1 << tree) - 1
    node, n, stray, trees = (right[c].to_numpy() for c in ("node", "n", "stray", "trees"))
    for i, (own, size, seen) in enumerate(zip(left["node"].tolist(), left["n"].tolist(), left["trees"].tolist())):
        def alike(choice: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(choice & (100 * np.minimum(n, size) >= share * np.maximum(n, size)) & (~stray | (node > own)))
            equal = m[at] == s[i]
            close = equal.sum(axis=1) >= LOOSE * HASHES
            at, equal = at[close], equal[close]
            both = trees[at] & seen & before
            for t in range(tree):
                again = (both >> t & 1).astype(bool)
                if again.any():
                    stay = ~(again & equal[:, _ORDER[t, :LEAST]].all(axis=1))
                    at, equal, both = at[stay], equal[stay], both[stay]
            return at

        yield i, alike


def _links_left(rest: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b): links between components among the rows of ``_left_over``, by their full sets.

    A block yields no link between components that it has already joined.
    """

    def confirm(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            items = [np.frombuffer(x, U64) for x in right["items"]]
            known, code = np.unique(np.concatenate(items), return_inverse=True)
            n = np.array([len(x) for x in items])
            start = np.cumsum(n) - n
            own_comp, comp = left["comp"].to_numpy().copy(), right["comp"].to_numpy().copy()
            mine, theirs = left["comp"].tolist(), right["comp"].tolist()
            hit = np.zeros(len(known), bool)
            for i, alike in _alike(left, right, share):
                at = alike(comp != own_comp[i])
                if not len(at):
                    continue
                x = np.frombuffer(left["items"].iat[i], U64)
                place = np.searchsorted(known, x)
                place = place[place < len(known)]
                place = place[known[place] == x[:len(place)]]
                hit[place] = True
                both = np.array([np.count_nonzero(hit[code[a:b]]) for a, b in zip(start[at].tolist(), (start[at] + n[at]).tolist())])
                hit[place] = False
                for j in at[100 * both >= share * (len(x) + n[at] - both)].tolist():
                    if comp[j] != own_comp[i]:
                        found.append((mine[i], theirs[j]))
                        old, new = comp[j], own_comp[i]
                        comp[comp == old] = new
                        own_comp[own_comp == old] = new
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rows = rest.join(sets, "node")
    left, right = rows.filter("side = 0").toDF(*rows.columns), rows.filter("side = 1").toDF(*rows.columns)
    return left.groupBy("region", "l", "r").cogroup(right.groupBy("region", "l", "r")).applyInPandas(confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, share: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``size``: words of a shingle; ``share``: least intersection in hundredths of the union.
    """
    spark = docs.sparkSession
    rows, _ = keep(signed(docs, size, doc_id, text), "forest-rows")
    nodes, _ = keep(rows.filter("node IS NOT NULL").groupBy("node", "n_shingles")
                    .agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig")), "forest-nodes")
    labels, labels_path = keep(_labels(nodes), "forest-labels")
    pairs, pairs_path = keep(_pairs(labels, share), "forest-candidates")
    sets = links = roots = None

    def texts_of(ends: DataFrame) -> None:
        """Read the full sets of more nodes."""
        nonlocal sets
        if sets is not None:
            ends = ends.join(sets.select("node"), "node", "left_anti")
        if sets is None or ends.limit(1).count():
            more, _ = keep(_sets(docs, nodes.join(ends, "node", "left_semi"), size, doc_id, text), "forest-sets")
            sets = more if sets is None else sets.unionByName(more)

    # every node's best candidate first, then all that still lead to another component and come near
    tried = None
    for best_only in (True, False):
        open_pairs = _across(pairs, roots)
        if best_only:
            both = open_pairs.select("a", "b", "score").unionByName(open_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
            best = both.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
            open_pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            open_pairs = _near(open_pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), nodes)
        open_pairs, open_path = keep(open_pairs.select("a", "b"), "forest-open")
        if not open_pairs.limit(1).count():
            discard(spark, open_path)
            break
        if best_only:  # the texts are read once for all of these candidates
            texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        done, _ = keep(_confirm(open_pairs, sets, share), "forest-confirmed")
        discard(spark, open_path)
        tried = done.select("a", "b")
        new = done.filter("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        roots, _ = keep(components(links, "a", "b"), "forest-roots")
    if roots is None:
        roots = nodes.limit(0).select("node", F.col("node").alias("root"))
    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rest = _left_over(labels, nodes, roots, share)
    if rest.limit(1).count():
        texts_of(rest.select("node").distinct())
        left, _ = keep(_links_left(rest, sets, share), "forest-left")
        if left.limit(1).count():
            joined, _ = keep(components(left, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("to")), "forest-joined")
            named = named.join(joined, "root", "left").select("node", "first", F.coalesce("to", "root").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = named.join(smallest, "root").select("node", "component_id")
    by_node, _ = keep(by_node, "forest-result")
    discard(spark, labels_path, pairs_path)
    return (rows.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
