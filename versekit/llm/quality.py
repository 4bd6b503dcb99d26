"""Quality rules: counting rules, and perplexity bands of an n-gram model per language.

The model is an interpolated modified Kneser-Ney model (Chen and Goodman 1999)
over bytes of the lower-cased text (digits alike, white space alike), one per
language, of order ``ORDER``.  Spark counts the n-grams of every document that
passes the counting rules and has at most ``SYMBOL_SHARE`` symbols a word (so that
the model holds prose, and menus or symbol soup are unlikely under it): tasks
add up what they read, one shuffle adds up the tasks; lower orders are
continuation counts (distinct left extensions) derived from the table above
them, and discounts, context totals and probabilities are joins and
aggregations over these tables.  It grows with the corpus.  Up to ``MAX_LOCAL``
entries it is broadcast as sorted arrays: 64-bit hashes of n-grams (or contexts)
with a log probability (or back-off weight), 12 bytes an entry.  A larger model
stays in its tables: the different n-grams of the documents meet them in shuffled
joins, and the documents' n-gram counts meet the results.

A document's score is the mean log probability of its bytes.  Per language, the
median and the spread (interquartile range) of the scores of documents
that pass the counting rules give a lower and an upper perplexity band; a
document outside is rejected.

Every language has a band: its median and spread count with the number of its
documents, those of all languages together like ``PRIOR_DOCS`` documents, so the
fewer documents a language has, the closer its band is to the common one.  The
model of a small language fits its own texts too well, so its upper end is also
measured from its own scores, from the highest of them the more the fewer they are, by no less than its own spread.

Defined results: a null text has no words; a null language is the empty
one; repeated rows are judged alike; an empty table gives an empty result; other
columns than the text, the language and those to carry are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versekit.llm.store import discard, keep
from versekit.llm.textbuf import U64, Prefix, mix, slices, utf8, words

ORDER = 5
#: A model of more entries is not broadcast.
MAX_LOCAL = 1 << 24
#: Documents that the values of all languages together count for in a language's band.
PRIOR_DOCS = 100
#: Half widths of the bands in robust standard deviations: (lower, upper); 3.5 is the usual
#: cut for outliers by robust scores (Iglewicz and Hoaglin 1993).
BANDS = (3.5, 3.5)
#: Interquartile range of a normal distribution, in standard deviations.
IQR_SPREAD = 1.349
#: Least robust standard deviation of a language's mean log probability.
LEAST_SPREAD = 0.03
#: Most symbols per word in a document that the model is counted from.
SYMBOL_SHARE = 0.1
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def base_features(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the counting rules for every text of a buffer."""
    rows = len(off) - 1
    start, end, row = words(data, off)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": _per_row(~space & ((data & 0xC0) != 0x80), off),
           "n_symbols": _per_row(symbol[data], off)}
    hashes = Prefix(data)
    # lines: one starts with every text and behind every line feed
    feed = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], feed + 1]))
    line_row = np.concatenate([np.arange(rows), np.searchsorted(off, feed, side="right") - 1])[
        np.argsort(np.concatenate([off[:-1], feed + 1]), kind="stable")]
    line_end = np.minimum(off[line_row + 1], np.concatenate([feed, [len(data)]])[np.searchsorted(feed, line_start)])
    n_inside = np.concatenate([[0], np.cumsum(~space)])
    full = (n_inside[line_end] > n_inside[line_start]) & (line_end > line_start)
    key = mix(hashes.slice(line_start[full], line_end[full]) ^ mix(line_row[full]))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_row[full][again], minlength=rows)
    # three-word windows inside one text, found twice or more there
    w = hashes.slice(start, end)
    covered = np.zeros(len(w), bool)
    if len(w) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        h = mix(mix(mix(w[at] ^ mix(row[at])) + w[at + 1]) + w[at + 2])
        _, which, n = np.unique(h, return_inverse=True, return_counts=True)
        twice = at[n[which] > 1]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _prose(f: dict[str, np.ndarray]) -> np.ndarray:
    """Documents that the model is counted from."""
    return (f["n_words"] >= 50) & (100 * f["n_repeat_words"] <= 50 * f["n_words"]) & (f["n_symbols"] <= SYMBOL_SHARE * f["n_words"])


def _alphabet() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8)
    a[65:91] += 32
    a[48:58] = 48
    a[[9, 10, 11, 12, 13]] = 32
    a[0] = 1  # 0 stands before a text
    return a


def _grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at every byte, packed into the low bytes (texts begin with order - 1 zeros)."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pad = np.zeros(len(data) + (order - 1) * (len(off) - 1), np.int64)
    at = np.arange(len(data)) + (order - 1) * (row + 1)
    pad[at] = _alphabet()[data]
    g = np.zeros(len(data), np.int64)
    for k in range(order - 1, -1, -1):
        g = g << 8 | pad[at - k]
    return g


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all texts of prose."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in it:
            for part in slices(batch, "t"):
                data, off = utf8(part.column("t"))
                code = np.array([names.setdefault(x, len(names)) for x in part.column("g").to_pylist()], np.int64)
                g = _grams(data, off, order) | np.repeat(code, np.diff(off)) << (8 * order)
                g = g[np.repeat(_prose(base_features(data, off)), np.diff(off))]
                g.sort()
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                held.append((g[first], np.diff(np.append(first, len(g)))))
                if len(held) > 1 and sum(len(k) for k, _ in held) > 2_000_000:
                    held = [_merge(held)]
        if held:
            keys, n = _merge(held)
            langs = pa.array(list(names), pa.string())
            for i in range(0, len(keys), 100_000):
                k = keys[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(k >> (8 * order))), pa.array(k & ((1 << 8 * order) - 1)), pa.array(n[i:i + 100_000])], names=["lang", "gram", "n"])

    src = docs.select(F.col(text).alias("t"), F.coalesce(F.col(lang), F.lit("")).alias("g"))
    return src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts from counts of counts."""
    n = [F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.coalesce(F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(i / 2)) for i in (1, 2, 3)]
    return table.groupBy("lang").agg(*n).select("lang", *[F.greatest(F.lit(0.0), F.least(x, F.lit(float(i)))).alias(f"d{i}") for i, x in zip((1, 2, 3), d)])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """((lang, k, gram, logp), (lang, k, context, logb)) of every order k from the highest order's counts."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        types = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables[k], _ = keep(types, f"kn-types-{k}")
    grams, contexts, lower = None, None, None
    for k in range(1, order + 1):
        t = tables[k].withColumn("ctx", F.shiftright("gram", 8))
        n = F.col("n")
        ctx = (t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count(F.when(n == 1, 1)).alias("c1"),
                                            F.count(F.when(n == 2, 1)).alias("c2"), F.count(F.when(n > 2, 1)).alias("c3"))
               .join(_discounts(t), "lang")
               .withColumn("backoff", (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")))
        ctx, _ = keep(ctx, f"kn-contexts-{k}")
        off = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        below = F.lit(1 / 256)
        j = t.join(ctx, ["lang", "ctx"])
        if lower is not None:
            j = j.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower, ["lang", "low"])
            below = F.col("p_low")
        own = j.select("lang", "gram", ((n - off) / F.col("total") + F.col("backoff") * below).alias("p"))
        own, _ = keep(own, f"kn-{k}")
        lower = own.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_low"))
        g = own.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"))
        c = ctx.select("lang", F.lit(k).alias("k"), F.col("ctx").alias("gram"), F.log(F.greatest("backoff", F.lit(1e-9))).alias("logp"))
        grams, contexts = (g, c) if grams is None else (grams.unionByName(g), contexts.unionByName(c))
    return grams, contexts


def _lang_hash(names: list[str]) -> np.ndarray:
    """A 64-bit code of every language name, the same in every process."""
    import xxhash
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], U64)


def _key(lang: np.ndarray, gram: np.ndarray, k: int, kind: int) -> np.ndarray:
    return mix(lang + mix(gram.astype(U64) * U64(16) + U64(2 * k + kind)))


class HashArrays:
    """Sorted keys and their values, with the place where each range of keys begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = min(24, max(1, len(keys).bit_length()))
        self.shift = U64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)
        self.begin = np.append(self.begin, np.int32(len(keys)))

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """Value of every key; NaN where it is not stored."""
        out = np.full(len(key), np.nan, np.float32)
        bucket = (key >> self.shift).astype(np.int64)
        at, end, todo = self.begin[bucket], self.begin[bucket + 1], np.arange(len(key))
        while True:
            live = at < end
            if not live.all():
                at, end, todo = at[live], end[live], todo[live]
            if not len(todo):
                return out
            hit = self.keys[at] == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            at, end, todo = at[~hit] + 1, end[~hit], todo[~hit]


def model_arrays(grams: DataFrame, contexts: DataFrame) -> HashArrays:
    """The model's keys, hashed in tasks and gathered once: for models of at most ``MAX_LOCAL`` entries."""

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, code = np.unique(np.array(b.column("lang").to_pylist(), object), return_inverse=True)
            lang, k, kind = _lang_hash(names.tolist())[code], b.column("k").to_numpy(), b.column("kind").to_numpy()
            key = np.zeros(b.num_rows, U64)
            for x in np.unique(k).tolist():
                for y in (0, 1):
                    own = (k == x) & (kind == y)
                    key[own] = _key(lang[own], b.column("gram").to_numpy()[own], x, y)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(b.column("logp").to_numpy().astype(np.float32))], names=["key", "v"])

    both = grams.withColumn("kind", F.lit(0)).unionByName(contexts.withColumn("kind", F.lit(1)))
    table = both.mapInArrow(hashed, "key long, v float").toArrow()
    keys, values = table.column("key").to_numpy().astype(U64), table.column("v").to_numpy()
    order = np.argsort(keys)
    return HashArrays(keys[order], values[order])


def log_probabilities(model: HashArrays, lang: np.ndarray, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Log probability of each n-gram's last byte after the others; back-off where it was not seen."""
    out = model.look_up(_key(lang, gram, order, 0))
    todo = np.flatnonzero(np.isnan(out))
    weight = np.zeros(len(todo), np.float32)
    for k in range(order, 0, -1):
        if not len(todo):
            return out
        mask = (1 << 8 * k) - 1
        if k < order:
            got = model.look_up(_key(lang[todo], gram[todo] & mask, k, 0))
            seen = ~np.isnan(got)
            out[todo[seen]] = got[seen] + weight[seen]
            todo, weight = todo[~seen], weight[~seen]
        back = model.look_up(_key(lang[todo], (gram[todo] & mask) >> 8, k, 1))
        weight = weight + np.nan_to_num(back, nan=0.0)
    out[todo] = weight - np.float32(np.log(256))
    return out


def score(docs: DataFrame, model: HashArrays, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",),
          order: int = ORDER) -> DataFrame:
    """The ``carry`` columns of every document, its base features and ``mean_logp`` (null for an empty text)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.values))
    fields = [f"c{i}" for i in range(len(carry))]
    src = docs.select(F.col(text).alias("t"), F.coalesce(F.col(lang), F.lit("")).alias("g"), *[F.col(c).alias(f) for c, f in zip(carry, fields)])
    schema = ", ".join([f"{f} {docs.schema[c].dataType.simpleString()}" for c, f in zip(carry, fields)] + ["g string", BASE, "mean_logp double"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = HashArrays(*sent.value)
        for batch in it:
            for part in slices(batch, "t"):
                data, off = utf8(part.column("t"))
                names, code = np.unique(np.array(part.column("g").to_pylist(), object), return_inverse=True)
                size = np.diff(off)
                lp = log_probabilities(arrays, np.repeat(_lang_hash(names.tolist())[code], size), _grams(data, off, order), order)
                total = np.bincount(np.repeat(np.arange(len(size)), size), weights=lp, minlength=len(size))
                mean = np.divide(total, size, out=np.zeros(len(size)), where=size > 0)
                base = base_features(data, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f) for f in fields] + [part.column("g")] + [pa.array(base[f.split()[0]], pa.int64()) for f in BASE.split(", ")] +
                    [pa.array(mean, pa.float64(), mask=size == 0)], names=[*fields, "g", *[f.split()[0] for f in BASE.split(", ")], "mean_logp"])

    return src.mapInArrow(run, schema)


def score_joined(docs: DataFrame, grams: DataFrame, contexts: DataFrame, text: str = "text", lang: str = "lang",
                 carry: tuple[str, ...] = ("doc_id",), order: int = ORDER) -> DataFrame:
    """``score`` with the model in its tables: nothing of it is broadcast."""
    # texts of one language are one text; their scores meet the documents by hash
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "t"):
                data, off = utf8(part.column("t"))
                row = np.repeat(np.arange(len(off) - 1), np.diff(off))
                g = _grams(data, off, order)
                at = np.lexsort((g, row))
                row, g = row[at], g[at]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])) if len(g) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("th").take(pa.array(row[first])), part.column("lang").take(pa.array(row[first])), pa.array(g[first]),
                                                  pa.array(np.diff(np.append(first, len(g))))], names=["th", "lang", "gram", "n"])

    texts = src.withColumn("th", F.xxhash64("t")).dropDuplicates(["lang", "th"])
    counts, counts_path = keep(texts.mapInArrow(count, "th long, lang string, gram long, n long"), "quality-text-grams")
    found = counts.select("lang", "gram").distinct().withColumns({"p": F.lit(None).cast("double"), "w": F.lit(0.0)})
    for k in range(order, 0, -1):
        mask = F.lit((1 << 8 * k) - 1)
        own = grams.filter(F.col("k") == k).select("lang", F.col("gram").alias("low"), F.col("logp").alias("own"))
        ctx = contexts.filter(F.col("k") == k).select("lang", F.col("gram").alias("ctx"), F.col("logp").alias("back"))
        found = (found.withColumn("low", F.col("gram").bitwiseAND(mask)).withColumn("ctx", F.shiftright("low", 8))
                 .join(own, ["lang", "low"], "left").join(ctx, ["lang", "ctx"], "left")
                 .select("lang", "gram", F.coalesce("p", F.col("w") + F.col("own")).alias("p"), (F.col("w") + F.coalesce("back", F.lit(0.0))).alias("w")))
    p = found.select("lang", "gram", F.coalesce("p", F.col("w") - math.log(256)).alias("p"))
    mean = counts.join(p, ["lang", "gram"]).groupBy("lang", "th").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean_logp"))
    mean, _ = keep(mean.withColumnsRenamed({"lang": "_g", "th": "_th"}), "quality-means")
    discard(docs.sparkSession, counts_path)
    # the base features, with an empty model
    none = HashArrays(np.zeros(0, U64), np.zeros(0, np.float32))
    base = score(docs.withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit("")))), none, text, lang, (*carry, "_th"), order).drop("mean_logp")
    th = f"c{len(carry)}"
    return base.join(mean, (F.col("g") == F.col("_g")) & (F.col(th) == F.col("_th")), "left").drop("_g", "_th", th)


def bands(scores: DataFrame, widths: tuple[float, float] = BANDS) -> DataFrame:
    """(g, low, high): the band of mean log probabilities of every language, from its passing documents and those of all languages."""
    ok = scores.filter(~F.col("failed") & F.col("mean_logp").isNotNull())
    # aggregates that tasks combine: no language's scores meet in one task
    q = F.percentile_approx("mean_logp", [0.25, 0.5, 0.75], 10_000)
    per, _ = keep(ok.groupBy("g").agg(q.alias("q"), F.max("mean_logp").alias("top"), F.count(F.lit(1)).alias("n")), "quality-quantiles")
    # the common spread is that inside languages: their medians differ
    inside = ok.join(per.select("g", F.col("q")[1].alias("own")), "g").select("mean_logp", (F.col("mean_logp") - F.col("own")).alias("off"))
    common = inside.agg(F.percentile_approx("mean_logp", 0.5, 10_000).alias("m"), F.percentile_approx("off", [0.25, 0.75], 10_000).alias("o"))
    share = F.col("n") / (F.col("n") + PRIOR_DOCS)
    least = F.lit(LEAST_SPREAD)
    own, all_ = F.greatest((F.col("q")[2] - F.col("q")[0]) / IQR_SPREAD, least), F.greatest((F.col("o")[1] - F.col("o")[0]) / IQR_SPREAD, least)
    s = share * own + (1 - share) * all_
    mid = share * F.col("q")[1] + (1 - share) * F.col("m")
    return per.crossJoin(common).select("g", (mid - widths[1] * s).alias("low"), (F.greatest(mid, share * F.col("q")[1] + (1 - share) * F.col("top")) + widths[0] * F.greatest(s, own)).alias("high"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",),
          widths: tuple[float, float] = BANDS) -> DataFrame:
    """The ``carry`` columns, base features, ``base_failed``, ``perplexity`` and ``kept`` of every document."""
    counts, counted = keep(count_grams(docs, text, lang), "gram-counts")
    grams, contexts = kneser_ney(counts)
    discard(docs.sparkSession, counted)
    if grams.count() + contexts.count() <= MAX_LOCAL:
        scored = score(docs, model_arrays(grams, contexts), text, lang, carry)
    else:
        scored = score_joined(docs, grams, contexts, text, lang, carry)
    scored, _ = keep(scored.withColumn("failed", F.coalesce(base_failed(), F.lit(True))), "quality-scores")
    j = scored.join(bands(scored, widths), "g", "left")
    inside = F.coalesce(F.col("mean_logp").between(F.col("low"), F.col("high")), F.lit(True))
    return j.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[f.split()[0] for f in BASE.split(", ")],
                    F.col("failed").alias("base_failed"), (~F.col("failed") & inside).alias("kept"), F.exp(-F.col("mean_logp")).alias("perplexity"))
