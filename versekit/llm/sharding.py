"""Shards of near-equal size by histogram sort.

Rows are ordered by (hash of the text, document id), so equal texts stand
together.  A splitter is sought for every shard boundary: each round one Spark
job counts the exact bytes and rows below all candidate boundaries (probes);
the driver keeps, for every splitter, the tightest bracket around its target
and places new probes inside it until the splitter meets the tolerance or lies
between two neighbouring keys.  Splitters are first sought between texts, so
equal texts stay in one shard where the tolerance allows it, and inside a
group of equal texts (by document id) only where the group itself is too large.
The same rounds find the cuts of the parts inside the shards, whose weight
counts bytes and rows alike, so every sorting task is bounded however large a
shard is.  Then the rows are exchanged once, by part.

What the driver holds is a few numbers per probe; probes are bounded by the
number of parts.  Defined results: a null text has size 0 and the overhead; a
null id sorts first; repeated rows (same id and text) stay in one part; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versekit.llm.store import keep

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: A bracket with at most so many rows is probed at its own keys.
FEW = 256


def _source(rows: DataFrame, groups: list[int], group: str | None, key: str) -> DataFrame:
    src = rows.select(F.col(group).alias("g") if group else F.lit(0).cast("long").alias("g"), F.col(key).alias("k"), "size")
    return src.filter(F.col("g").isin(groups)) if group else src


def _keys(rows: DataFrame, seeks: list[tuple[int, _Seek]], group: str | None, key: str) -> dict[int, list[int]]:
    """The distinct keys inside brackets of few rows: at most ``FEW`` for every splitter."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for g, s in seeks:
        spans.setdefault(g, []).append((s.lo[0], min(s.hi[0], HIGH)))

    def inside(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            g, k, keep_row = pdf["g"].to_numpy(), pdf["k"].to_numpy(), np.zeros(len(pdf), bool)
            for x, own in spans.items():
                lo = np.sort(np.array([a for a, _ in own], np.int64))
                hi = np.sort(np.array([b for _, b in own], np.int64))
                keep_row |= (g == x) & (np.searchsorted(lo, k, "right") > np.searchsorted(hi, k, "left"))
            yield pdf.loc[keep_row, ["g", "k"]].drop_duplicates()

    out: dict[int, list[int]] = {}
    for r in _source(rows, list(spans), group, key).mapInPandas(inside, "g long, k long").distinct().collect():
        out.setdefault(r["g"], []).append(r["k"])
    return {g: sorted(k) for g, k in out.items()}


def _counts(rows: DataFrame, probes: dict[int, list[int]], group: str | None, key: str) -> dict[int, list[tuple]]:
    """Bytes and rows in every gap between the sorted probes of every group: {group: [(bytes, rows), ...]}."""
    groups = np.array(sorted(probes), dtype=np.int64)
    edges = [np.array(probes[g], dtype=np.int64) for g in groups.tolist()]

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            g = pdf["g"].to_numpy()
            at = np.searchsorted(groups, g)
            k, size, out = pdf["k"].to_numpy(), pdf["size"].to_numpy(), []
            for i in np.unique(at).tolist():
                own = at == i
                gap = np.searchsorted(edges[i], k[own], side="right")
                n = len(edges[i]) + 1
                total = np.zeros(n, np.int64)
                np.add.at(total, gap, size[own])
                n_rows = np.bincount(gap, minlength=n)
                some = np.flatnonzero(n_rows)
                out.append(pd.DataFrame({"g": groups[i], "gap": some, "size": total[some], "n": n_rows[some]}))
            if out:
                yield pd.concat(out)

    got = (_source(rows, groups.tolist(), group, key).mapInPandas(count, "g long, gap long, size long, n long")
           .groupBy("g", "gap").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect())
    out = {int(g): [(0, 0)] * (len(e) + 1) for g, e in zip(groups, edges)}
    for r in got:
        out[r["g"]][r["gap"]] = (r["size"], r["n"])
    return out


class _Seek:
    """One splitter: the smallest key whose rows below weigh at least the target, within a tolerance.

    A cut at key k puts keys < k below it.  ``lo``/``hi``: cuts known to weigh
    less / not less than the target, with (bytes, rows) below.
    """

    def __init__(self, target: float, tol: float, weigh, lo: tuple, hi: tuple, shift: tuple[int, int] = (0, 0)):
        self.target, self.tol, self.weigh, self.lo, self.hi = target, tol, weigh, lo, hi
        self.shift = shift  # (bytes, rows) below the group that the counts are taken in
        self.inner: _Seek | None = None

    def best(self) -> tuple:
        return min((self.lo, self.hi), key=lambda c: abs(self.weigh(c[1]) - self.target))

    def met(self) -> bool:
        return abs(self.weigh(self.best()[1]) - self.target) <= self.tol or self.hi[0] - self.lo[0] <= 1

    def probes(self, per: int) -> list[int]:
        """New cuts inside the bracket: an even grid and a finer one around the interpolated place."""
        a, b = self.lo[0], self.hi[0]
        wa, wb = self.weigh(self.lo[1]), self.weigh(self.hi[1])
        share = min(max((self.target - wa) / max(wb - wa, 1e-9), 0.0), 1.0)
        mid, step = a + int(share * (b - a)), max(1, (b - a) // (per * per))
        near = [mid + i * step for i in range(-(per // 2), per // 2 + 1)]
        return [p for p in {a + (b - a) * i // per for i in range(1, per)} | set(near) if a < p < b]

    def learn(self, cuts: list[int], size: list[int], n: list[int]) -> None:
        """Narrow the bracket; ``size`` and ``n`` are what lies below each cut."""
        i, j = bisect.bisect_right(cuts, self.lo[0]), bisect.bisect_left(cuts, self.hi[0])
        for c, w in zip(cuts[i:j], zip(size[i:j], n[i:j])):
            w = (w[0] + self.shift[0], w[1] + self.shift[1])
            if self.weigh(w) < self.target:
                self.lo = (c, w)
            else:
                self.hi = (c, w)
                break


def _refine(rows: DataFrame, seeks: list[tuple[int, _Seek]], group: str | None, key: str, per: int) -> None:
    """Rounds of probing until every splitter is met; ``seeks`` are (group, splitter)."""
    while todo := [(g, s) for g, s in seeks if not s.met()]:
        probes: dict[int, set] = {g: set() for g, _ in todo}
        few = [(g, s) for g, s in todo if s.hi[1][1] - s.lo[1][1] <= FEW]
        own = _keys(rows, few, group, key) if few else {}
        for g, s in todo:
            if s.hi[1][1] - s.lo[1][1] > FEW:
                probes[g].update(s.probes(per))
            else:
                keys = own.get(g, [])
                inside = keys[bisect.bisect_left(keys, s.lo[0]):bisect.bisect_left(keys, s.hi[0])]
                probes[g].update(c for k in inside for c in (k, k + 1) if s.lo[0] < c < s.hi[0])
        cuts = {g: sorted(p) for g, p in probes.items()}
        # a probe c stands for "keys < c": searchsorted(side=right) puts a key equal to c above it
        gaps = _counts(rows, cuts, group, key)
        for g, c in cuts.items():
            size, n = (np.cumsum([x[i] for x in gaps[g][:-1]]).tolist() for i in (0, 1))
            for s in (s for gg, s in todo if gg == g):
                s.learn(c, size, n)


def histogram_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8,
                     tolerance: float = 1e-4, part_bytes: int = 256 << 20, least_parts: int = 4,
                     probes: int = 32) -> DataFrame:
    """All rows of ``docs`` with their ``size``, ``shard`` and ``slot`` (gapless from 0 in key order).

    These three stand in place of columns of ``docs`` with their names; all others are returned as they are.

    ``tolerance``: allowed distance of a splitter from its target, as a share
    of a shard; finer than one document is not possible.  ``part_bytes``: what
    one sorting task takes, with at least ``least_parts`` parts a shard.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    # the caller's columns travel as one value, so that no name of theirs meets one of these
    sized = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), (F.octet_length(t).cast("long") + F.lit(overhead)).alias("size"), F.xxhash64(t).alias("_h"),
                        F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW).cast("long")).alias("_i"))
    keys, _ = keep(sized.select("_h", "_i", "size"), "shard-keys")
    n, total = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return sized.select("_row.*", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = shards * max(least_parts, -(-total // (shards * part_bytes)))
    weights = (lambda w: float(w[0]), lambda w: w[0] / total + w[1] / n)
    end = (HIGH + 1, (total, n))
    # every part boundary; each (parts / shards)-th is a shard boundary and counts bytes alone
    step = parts // shards
    seeks = [_Seek(total * (k // step) / shards, tolerance * total / shards, weights[0], (LOW, (0, 0)), end)
             for k in range(step, parts, step)]
    _refine(keys, [(0, s) for s in seeks], None, "_h", probes)
    _inside(keys, seeks, probes)
    bounds = [(LOW, LOW, (0, 0)), *(_place(s) for s in seeks), (HIGH + 1, LOW, (total, n))]
    fine = []
    for a, b in zip(bounds, bounds[1:]):
        wa, wb = weights[1](a[2]), weights[1](b[2])
        for i in range(1, step):
            fine.append(_Seek(wa + (wb - wa) * i / step, 0.1 * 2 / parts, weights[1], (LOW, (0, 0)), end))
    _refine(keys, [(0, s) for s in fine], None, "_h", probes)
    _inside(keys, fine, probes)
    cuts = sorted([(h, i, w, 1) for h, i, w in bounds[1:-1]] + [(*_place(s), 0) for s in fine], key=lambda c: (c[0], c[1], c[3]))
    ch, ci = np.array([min(c[0], HIGH) for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
    # a cut behind the last hash has no row above it
    past = np.array([c[0] > HIGH for c in cuts], bool)
    shard_of = np.concatenate([[0], np.cumsum([c[3] for c in cuts])]).astype(np.int32)
    rows_below = np.array([0] + [c[2][1] for c in cuts], np.int64)
    first = np.searchsorted(shard_of, np.arange(shards))
    slot0 = rows_below - rows_below[np.minimum(first, len(rows_below) - 1)][shard_of]

    @F.pandas_udf("part int, shard int, base long")
    def place(h: pd.Series, i: pd.Series) -> pd.DataFrame:
        kh, ki = h.to_numpy(), i.to_numpy()
        lo, hi = np.zeros(len(kh), np.int64), np.full(len(kh), len(ch), np.int64)
        while (lo < hi).any():  # number of cuts at or below (h, i)
            mid = np.minimum((lo + hi) // 2, max(len(ch) - 1, 0))
            under = ((ch[mid] < kh) | ((ch[mid] == kh) & (ci[mid] <= ki))) & ~past[mid]
            live = lo < hi
            lo, hi = np.where(live & under, mid + 1, lo), np.where(live & ~under, mid, hi)
        return pd.DataFrame({"part": lo.astype(np.int32), "shard": shard_of[lo], "base": slot0[lo]})

    w = Window.partitionBy("_part").orderBy("_h", "_i")
    placed = sized.withColumn("_p", place("_h", "_i")).withColumns({"_part": F.col("_p.part"), "shard": F.col("_p.shard"), "_base": F.col("_p.base")})
    return placed.select("_row.*", "size", "shard", (F.col("_base") + F.row_number().over(w) - 1).alias("slot"))


def _inside(keys: DataFrame, seeks: list[_Seek], per: int) -> None:
    """Splitters stuck between two neighbouring hashes: go on inside that group of equal texts, by id."""
    stuck = [s for s in seeks if abs(s.weigh(s.best()[1]) - s.target) > s.tol]
    for s in stuck:
        s.inner = _Seek(s.target, s.tol, s.weigh, (LOW, s.lo[1]), (HIGH, s.hi[1]), s.lo[1])
    _refine(keys, [(s.lo[0], s.inner) for s in stuck], "_h", "_i", per)


def _place(s: _Seek) -> tuple[int, int, tuple]:
    """(hash, id, (bytes, rows) below) of a splitter: rows with a smaller (hash, id) lie below it."""
    if s.inner is not None:
        key, w = s.inner.best()
        if key == HIGH and w == s.hi[1]:
            return s.hi[0], LOW, w
        return s.lo[0], key, w
    key, w = s.best()
    return key, LOW, w
