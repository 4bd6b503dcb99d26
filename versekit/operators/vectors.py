"""Vector operators: norms, centroids, exact top-k similarity, analogies, set similarity.

Vectors are ARRAY<FLOAT/DOUBLE> columns keyed by an id.  Group means are one
aggregate that is combined map-side, so a group of any size is summed where
it lies.  Exact nearest neighbours never materialise query x key pairs as
rows: blocks of queries meet blocks of keys, a task multiplies one pair of
blocks and only its best rows survive; a ``row_number() <= k`` over the
survivors (map-side WindowGroupLimit) gives the global top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def r6(c: Column) -> Column:
    """Round to 6 decimals (half up) so engines agree on float noise."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def norm(arr: Column) -> Column:
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(arr: Column) -> Column:
    """Unit-length vector; a zero vector gives NULL components (no ANSI division error)."""
    n = norm(arr)
    return F.transform(arr, lambda x: F.try_divide(x.cast("double"), n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def group_mean(vecs: DataFrame, group: str, vec: str, weight: str | None = None) -> DataFrame:
    """(group, vec): per-dimension (weighted) mean of the group's vectors, one combined aggregate."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    mean = Summarizer.mean(v, F.col(weight).cast("double")) if weight else Summarizer.mean(v)
    return (vecs.filter(F.col(vec).isNotNull()).groupBy(group).agg(mean.alias("_m"))
            .select(group, vector_to_array("_m").alias(vec)))


#: Queries and keys that one task multiplies.
QUERY_BLOCK, KEY_BLOCK = 512, 100_000
#: Keys multiplied at a time.
KEY_SLICE = 8_192


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)


def _matrix(rows) -> np.ndarray:
    return _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in rows]))


def _products(stack: tuple[np.ndarray, list[int]] | None, m: np.ndarray, n: int) -> np.ndarray:
    """For each of n queries the product of (1 + cosine) / 2 over its vectors; 1 without any."""
    if stack is None:
        return np.ones((n, len(m)))
    shifted, out, at = (1.0 + stack[0] @ m.T) / 2.0, np.ones((n, len(m))), 0
    for i, size in enumerate(stack[1]):
        out[i] = np.prod(shifted[at:at + size], axis=0)
        at += size
    return out


def top_k_similar(keys: DataFrame, key: str, vec: str, queries: DataFrame, qkey: str, qvec: str,
                  k: int = 10, exclude: DataFrame | None = None, mode: str = "cos",
                  neg: str | None = None) -> DataFrame:
    """Exact top-k keys per query, ties by key.

    mode ``cos``: cosine to the query vector ``qvec``.
    mode ``cosmul``: 3CosMul (Levy & Goldberg 2014) with ``qvec`` an
    ARRAY<ARRAY> of positive vectors and ``neg`` one of negative vectors:
    prod((1 + cos(v, p)) / 2) / (prod((1 + cos(v, n)) / 2) + 1e-6).

    Queries and keys are dealt into blocks by hash; each block of queries meets
    each block of keys in one task, which multiplies the two matrices and keeps
    every key at or above a query's k-th value, then cuts by (similarity, key).
    No query reaches the driver, and a block of either side has a bounded size.
    Similarities are compared at 12 decimals, so equal vectors tie in every
    task.  Ids may be of any type; a null query id is a query, rows without a
    vector take no part.  ``exclude`` (qkey, key) removes pairs (inputs of an analogy) before ranking.
    """
    spark = keys.sparkSession
    qtype, ktype = dict(queries.dtypes)[qkey], dict(keys.dtypes)[key]
    cols = [F.col(qkey).alias("q"), F.col(qvec).alias("v")] + ([F.col(neg).alias("n")] if neg else [])
    qs = queries.select(*cols).filter(F.col("v").isNotNull())
    if exclude is not None:
        x = exclude.groupBy(F.col(qkey).alias("_q")).agg(F.collect_set(key).alias("x"))
        qs = qs.join(x, qs["q"].eqNullSafe(x["_q"]), "left").drop("_q")
    ks = keys.select(F.col(key).alias("k"), F.col(vec).alias("v")).filter(F.col("v").isNotNull())
    qb = max(1, -(-qs.count() // QUERY_BLOCK))
    kb = max(1, -(-ks.count() // KEY_BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")) // qb)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = qs.withColumns({"qb": F.pmod(F.xxhash64("q"), F.lit(qb)), "kb": every(kb)})
    right = ks.withColumns({"kb": F.pmod(F.xxhash64("k"), F.lit(kb)), "qb": every(qb)})
    names, excluding = ["q", "k", "sim"], exclude is not None

    def best(group: tuple, own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(block):
            return pd.DataFrame(columns=names)
        if mode == "cos":
            asked = _matrix(own["v"])
        else:
            sides = [own["v"].tolist(), own["n"].tolist()]
            stacks = [(_matrix([v for row in side for v in row]), [len(row) for row in side]) if any(map(len, side)) else None for side in sides]
        held = pd.DataFrame(columns=["i", "k", "sim"])
        for at in range(0, len(block), KEY_SLICE):
            part = block.iloc[at:at + KEY_SLICE]
            m = _matrix(part["v"])
            if mode == "cos":
                sims = asked @ m.T
            else:
                up, down = (_products(stack, m, len(own)) for stack in stacks)
                sims = up / (down + 1e-6)
            sims = np.round(np.nan_to_num(sims, nan=-np.inf), 12)
            if excluding:
                for i, x in enumerate(own["x"]):
                    if x is not None:
                        sims[i, part["k"].isin(list(x)).to_numpy()] = -np.inf
            least = np.partition(sims, -k, axis=1)[:, [-k]] if sims.shape[1] > k else np.full((len(own), 1), -np.inf)
            i, j = np.nonzero((sims >= least) & (sims > -np.inf))
            found = pd.DataFrame({"i": i, "k": part["k"].to_numpy()[j], "sim": sims[i, j]})
            held = pd.concat([held, found]) if len(held) else found
            held = held.sort_values(["i", "sim", "k"], ascending=[True, False, True], kind="stable").groupby("i").head(k)
        q = np.empty(len(held), object)
        q[:] = [own["q"].iat[int(i)] for i in held["i"]]
        return held.assign(q=q)[names]

    cand = (left.groupBy("qb", "kb").cogroup(right.groupBy("qb", "kb"))
            .applyInPandas(best, f"q {qtype}, k {ktype}, sim double"))
    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), F.col("k"))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("q").alias(qkey), F.col("rank").cast("bigint").alias("rank"),
                    F.col("k").alias(key), "sim"))


def relaxed_wmd(pairs: DataFrame, pair: str, side: str, word_vecs: DataFrame, weight: str = "w") -> DataFrame:
    """Relaxed word mover's distance (Kusner et al. 2015) of every sentence pair.

    ``pairs``: (pair, side in {0, 1}, word, w) — the normalised bag-of-words
    weight of each distinct word of each side.  Vectors are unit length (as
    the original's default ``norm=True``); the distance is
    max(sum_a w_a min_b |a - b|, sum_b w_b min_a |a - b|).  One group is one
    sentence pair, bounded by the two sentences; the |A| x |B| distances are
    computed in numpy inside the task and never emitted as rows.  Pairs with
    a side that has no known word get NULL.
    """
    wv = word_vecs.select("word", F.col("v"))
    # a word without a vector stays as a row, so that a pair without any known word keeps its NULL
    j = pairs.join(wv, "word", "left").select(pair, side, "word", weight, "v")

    def rwmd(pdf: pd.DataFrame) -> pd.DataFrame:
        pid = pdf[pair].iloc[0]
        known = pdf[pdf["v"].notna()]
        a = known[known[side] == 0]
        b = known[known[side] == 1]
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({pair: [pid], "rwmd": [None]})
        ma = np.stack([np.asarray(v, dtype=np.float64) for v in a["v"]])
        mb = np.stack([np.asarray(v, dtype=np.float64) for v in b["v"]])
        ma = ma / np.maximum(np.linalg.norm(ma, axis=1, keepdims=True), 1e-300)
        mb = mb / np.maximum(np.linalg.norm(mb, axis=1, keepdims=True), 1e-300)
        wa = a[weight].to_numpy(dtype=np.float64)
        wb = b[weight].to_numpy(dtype=np.float64)
        wa, wb = wa / wa.sum(), wb / wb.sum()
        # |x - y|^2 = |x|^2 + |y|^2 - 2xy, a block of one side's words at a time
        na, nb = (ma ** 2).sum(axis=1), (mb ** 2).sum(axis=1)
        least_a, least_b = np.empty(len(ma)), np.full(len(mb), np.inf)
        for i in range(0, len(ma), 1024):
            d2 = na[i:i + 1024, None] + nb[None, :] - 2.0 * (ma[i:i + 1024] @ mb.T)
            least_a[i:i + 1024] = d2.min(axis=1)
            least_b = np.minimum(least_b, d2.min(axis=0))
        val = max(float((w * np.sqrt(np.maximum(x, 0.0))).sum()) for w, x in ((wa, least_a), (wb, least_b)))
        return pd.DataFrame({pair: [pid], "rwmd": [val]})

    ptype = dict(pairs.dtypes)[pair]
    return j.groupBy(pair).applyInPandas(rwmd, f"{pair} {ptype}, rwmd double")
