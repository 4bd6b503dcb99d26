"""Toxicity by compression distance: windows of a text are compressed with an ordinary and with a toxic dictionary.

Both dictionaries begin with what zstandard's trainer finds in ordinary text; the
toxic one goes on with the segments that toxic text uses far more often, the
ordinary one with as many bytes that no text holds, so that all else lies equally
far back and a window is shorter under the toxic dictionary only for what the
segments say.  Segments are words and beginnings of words, counted by distinct
contexts (word before, word after): copies of a text, and lines that repeat, count
once.  Kept are those whose rate in toxic text exceeds the rate in ordinary text
``RATIO`` times, two standard errors allowed on either side, and that are met in
one context for fifty toxic texts at least; of a segment and its continuations the purest stands.

A text is cut into windows of about ``WIDTH`` bytes at white space.  Before each
stands a carrier that both dictionaries end with: it pays for the frame, so
that every byte of a window shows in the length.  How many windows are shorter by
1, 2, ... bytes, and which share of all, gives the score by a logistic
calibration whose labelled texts took no part in the dictionaries.

Learning uses a bounded sample of labelled rows, chosen by a hash of the id: at most
``LEARN_DOCS`` texts of each kind, a piece of ``LEARN_CHARS`` each, for the dictionaries
and as many whole texts for the calibration, weighted to the labels' true shares.
Every document is scored whole, where it is read, without a shuffle.

Defined results: a null or empty text has no window and the score that the
calibration gives to that; a null id is scored and never learned from; several
label rows of an id count as toxic if one does; without labels of both kinds
every score is the share of toxic among them (0 without labels); repeated rows and
equal texts get equal scores; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versekit.llm.textbuf import MULT, U64, Prefix, mix, slices, utf8, words

LEARN_DOCS = 2048
LEARN_CHARS = 4096
WIDTH = 24
ORDINARY_BYTES = 1024
MOST_SEGMENTS = 512
RATIO = 4.0
SHORTEST, LONGEST, WHOLE_WORD = 4, 12, 24
RIDGE = 0.03
#: A window counts by how many bytes it is shorter, up to so many.
STEPS = 10
TOXIC_FROM = 0.7
#: Bytes that UTF-8 text never holds together: the carrier, what parts segments, and the ordinary dictionary's filling.
CARRIER = bytes(range(128, 160))
APART = b"\xff"
GROUP = 40_000
_SIGNS = np.isin(np.arange(256), np.frombuffer(b".,!?;:|\"'()[]", np.uint8))


@dataclass
class Model:
    """Two dictionaries, and the calibration of the counts of shorter windows (None: ``share`` stands for every text)."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] | None = None
    share: float = 0.0
    segments: list[str] = field(default_factory=list)


def cut(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of windows that tile the rows: a new one at the first white space after every ``width`` bytes."""
    space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    size = np.diff(off)
    more = np.maximum(size - 1, 0) // width
    row = np.repeat(np.arange(len(size)), more)
    at = off[row] + width * (np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more) + 1)
    k = np.searchsorted(space, at)
    start = space[k[k < len(space)]] if len(space) else np.zeros(0, np.int64)
    row = row[k < len(space)]
    inside = start < off[row + 1]
    start = np.unique(np.concatenate([off[:-1][size > 0], start[inside]])).astype(np.int64)
    return start, np.searchsorted(off, start, side="right") - 1


def _compressor(dictionary: bytes):
    import zstandard as z
    settings = z.ZstdCompressionParameters(window_log=15, chain_log=14, hash_log=14, search_log=4, min_match=5, target_length=32, strategy=z.STRATEGY_BTLAZY2,
                                           write_content_size=0, write_dict_id=0, write_checksum=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings)


_COMPRESSORS: dict[bytes, object] = {}


def compressors(model: Model) -> tuple:
    """A worker's compressors of the two dictionaries."""
    for d in (model.ordinary, model.toxic):
        if d not in _COMPRESSORS:
            if len(_COMPRESSORS) > 8:
                _COMPRESSORS.clear()
            _COMPRESSORS[d] = _compressor(d)
    return _COMPRESSORS[model.ordinary], _COMPRESSORS[model.toxic]


def gains(data: np.ndarray, start: np.ndarray, pair: tuple) -> np.ndarray:
    """By how many bytes each window is shorter under the second compressor; windows tile ``data``."""
    from zstandard import BufferWithSegments
    ends, out = np.append(start[1:], len(data)), np.zeros(len(start), np.int64)
    head = np.frombuffer(CARRIER, np.uint8)
    for i in range(0, len(start), GROUP):
        a, b = start[i:i + GROUP], ends[i:i + GROUP]
        size = b - a
        held = np.empty(int(size.sum()) + len(head) * len(a), np.uint8)
        first = a - a[0] + len(head) * np.arange(len(a))
        held[first[:, None] + np.arange(len(head))] = head
        text = np.ones(len(held), bool)
        text[first[:, None] + np.arange(len(head))] = False
        held[text] = data[a[0]:b[-1]]
        parts = np.stack([first, size + len(head)], axis=1).astype(np.uint64)
        blocks = BufferWithSegments(held.tobytes(), parts.tobytes())
        lengths = [np.fromiter(map(len, c.multi_compress_to_buffer(blocks)), np.int64, len(a)) for c in pair]
        out[i:i + GROUP] = lengths[0] - lengths[1]
    return out


def features(column: pa.Array, model: Model) -> np.ndarray:
    """One row per text: for 1 to ``STEPS`` bytes, windows that gain as much (logarithm, root of the share); logarithm of all."""
    data, off = utf8(column)
    n = len(off) - 1
    start, row = cut(data, off)
    gain = np.clip(gains(data, start, compressors(model)), 0, STEPS) if len(start) else np.zeros(0, np.int64)
    counts = np.bincount(row * (STEPS + 1) + gain, minlength=n * (STEPS + 1)).reshape(n, STEPS + 1).astype(float)
    least = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    every = least[:, :1]
    return np.hstack([np.log1p(least[:, 1:]), np.sqrt(least[:, 1:] / np.maximum(every, 1)), np.log1p(every)])


def _sides(texts: list[str], lengths: range) -> tuple[dict[int, tuple[int, bytes]], int]:
    """Hash of every segment: (distinct contexts, its bytes); and the distinct contexts of all words."""
    data, off = utf8(pa.array(texts, pa.string()))
    start, end, row = words(data, off)
    for _ in range(4):  # signs around a word
        start = start + (_SIGNS[data[np.minimum(start, len(data) - 1)]] & (end - start > 1)) if len(start) else start
        end = end - (_SIGNS[data[np.maximum(end - 1, 0)]] & (end - start > 1)) if len(end) else end
    if not len(start):
        return {}, 0
    p = Prefix(data)
    whole = p.slice(start, end)
    before, after = np.zeros_like(whole), np.zeros_like(whole)
    same = row[1:] == row[:-1]
    before[1:][same] = whole[:-1][same]
    after[:-1][same] = whole[1:][same]
    context = mix(before * U64(3) + mix(after))
    found: dict[int, tuple[int, bytes]] = {}
    inner = (np.append(data, 0) & 0xC0) == 0x80  # bytes within a character
    for k in [*lengths, 0]:
        stop = start + k if k else end
        ok = (end - start >= k) & ~inner[np.minimum(stop, len(data))] if k else (end - start > lengths[-1]) & (end - start <= WHOLE_WORD)
        a, b = start[ok], stop[ok]
        h = p.slice(a, b)
        _, one = np.unique(mix(h + context[ok] * U64(MULT)), return_index=True)
        unit, first, n = np.unique(h[one], return_index=True, return_counts=True)
        for u, i, c in zip(unit.tolist(), one[first].tolist(), n.tolist()):
            if c > 2:
                found[u] = (c, data[a[i]:b[i]].tobytes())
    return found, len(np.unique(mix(whole + context * U64(MULT))))


def segments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Beginnings of words that toxic texts use far more often, the most telling first."""
    lengths = range(SHORTEST, LONGEST + 1)
    (mine, n1), (theirs, n0) = _sides(toxic, lengths), _sides(ordinary, lengths)
    rate, count = {}, {}
    for h, (c, unit) in mine.items():
        other = theirs.get(h, (0, b""))[0]
        low = max(c - 2 * math.sqrt(c), 0.0) / n1 * max(n0, 1) / (other + 2 * math.sqrt(other + 1))  # two standard errors on either side
        if c >= 0.02 * len(toxic) and low > RATIO:
            rate[unit], count[unit] = math.log(low), c
    stands: set[bytes] = set()
    for x in rate:  # a longer segment stands for its beginnings when it has nearly all of their contexts
        stands.update(x[:k] for k in range(1, len(x)) if count.get(x[:k], math.inf) * 0.8 <= count[x])
    kept: list[bytes] = []
    for x in sorted(rate, key=lambda x: (len(x), x)):
        if x not in stands and not any(x[:k] in rate and x[:k] not in stands and rate[x] < rate[x[:k]] + math.log(2) for k in range(1, len(x))):
            kept.append(x)
    return sorted(kept, key=lambda x: (-count[x] * rate[x], x))[:MOST_SEGMENTS]


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """The dictionaries of two samples of texts."""
    import zstandard as z
    pieces = [t.encode()[i:i + 1024] for t in ordinary for i in range(0, len(t.encode()), 1024)]
    try:
        common = z.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()[-ORDINARY_BYTES:]
    except (z.ZstdError, ValueError):  # too little text for the trainer
        common = b"".join(pieces)[-ORDINARY_BYTES:]
    chosen = segments(toxic, ordinary)
    own = APART.join(b" " + s + b" " for s in reversed(chosen))  # the most telling ones are nearest
    filling = bytes(random.Random(1).choices(range(160, 192), k=len(own)))
    return Model(common + filling, common + own, segments=[s.decode(errors="replace") for s in chosen])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weights of a logistic regression (constant first, without a ridge), by Newton's method."""
    x, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = RIDGE * np.eye(len(b))
    ridge[0, 0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return b.tolist()


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3; rows of remainder 1 are never learned from."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model from labelled rows of remainders 0 (dictionaries) and 2 (calibration)."""
    known = (labels.filter(F.col(doc_id).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").alias("_y"))
             .withColumn("_fold", fold(F.col("_id"))).filter("_fold != 1"))
    sizes = {(r["_fold"], r["_y"]): r["count"] for r in known.groupBy("_fold", "_y").count().collect()}
    every = sum(sizes.values())
    share = sum(n for (_, y), n in sizes.items() if y == 1) / every if every else 0.0
    if any((f, y) not in sizes for f in (0, 2) for y in (0, 1)):
        return Model(share=share)
    chosen = None
    for f, y in sizes:
        some = known.filter((F.col("_fold") == f) & (F.col("_y") == y)).orderBy(F.xxhash64("_id"), "_id").limit(LEARN_DOCS)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 4 * LEARN_DOCS rows, so they are broadcast and the texts stay where they are
    own = (docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id"))
    start = F.pmod(F.xxhash64("_text"), F.greatest(F.length("_text") - LEARN_CHARS, F.lit(0)) + 1).cast("int") + 1
    pieces = own.filter("_fold = 0").select("_id", "_y", F.substring("_text", start, F.lit(LEARN_CHARS)).alias("t")).collect()
    pieces.sort(key=lambda r: (r["_id"], r["t"]))
    model = train([r["t"] for r in pieces if r["_y"] == 1], [r["t"] for r in pieces if r["_y"] == 0])

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "_text"):
                x = features(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_y", "x"])

    rows = own.filter("_fold = 2").select(F.col("_y").cast("int").alias("_y"), "_text").mapInArrow(measure, "_y int, x array<double>").collect()
    rows.sort()
    y = np.array([r["_y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(share=share)
    true = {k: sum(n for (_, c), n in sizes.items() if c == k) / every for k in (0, 1)}
    weight = np.where(y == 1, true[1] / (y == 1).mean(), true[0] / (y == 0).mean())
    model.weights, model.share = calibrate(np.array([r["x"] for r in rows]), y, weight), share
    return model


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "t"):
                if model.weights is None:
                    s = np.full(part.num_rows, model.share)
                else:
                    # summed row by row, so that a score doesn't depend on the batch
                    z = (np.c_[np.ones(part.num_rows), features(part.column(2), model)] * np.array(model.weights)).sum(axis=1)
                    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= TOXIC_FROM).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 1).alias("held_out"), F.col(text).alias("t"))
    return rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document scored by a model learned from the labels."""
    return score(docs, learn(docs, labels, text, doc_id), text, doc_id)
