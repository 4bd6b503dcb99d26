"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters, or of digits with inner points and
commas), lower-cased, with typed placeholders: numbers (digits and number
words), units (a word of ``UNITS`` behind a number) and names (a capitalised word
inside a sentence).  Windows of ``WINDOW`` template tokens are hashed; document
windows and benchmark windows meet in a hash join.  Names are also compared as
plain words (a second form of every window that holds one), so changed case or
punctuation does not hide a copy; a capitalised word that opens a sentence may be a
name or not, so windows with one have a form in which it is typed as a name too.  A pair of document and item is contaminated if
at least ``SHARE`` of the item's windows are found in one place of the document, in
the item's order (within the drift of a few inserted words), with consistent
slots: each placeholder value of the item stands for one value of the document and no two
of them for the same, so re-parameterised questions are caught and texts that
only share a skeleton are not.

Document windows that no benchmark window equals are dropped in the task that
makes them while the benchmark has at most ``MAX_LOCAL`` windows; beyond that all
windows go through the shuffled join.

Defined results: a null or empty text and an item of fewer than ``WINDOW`` tokens
match nothing; repeated rows give one result row; repeated item ids with
different texts are items of their own that report the same id; a null document id
is an id of its own; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versekit.llm.textbuf import MULT, U64, Prefix, mix, slices, utf8

WINDOW = 5
SHARE = 0.8
MAX_LOCAL = 4_000_000
SIEVE_BITS = 23
NUMBER, UNIT, NAME = 1, 2, 3
# Words typed as units behind a number, and words typed as numbers.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes "
         "second seconds meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms liter liters "
         "litre litres pound pounds ounce ounces dollar dollars cent cents euro euros usd eur percent degree degrees kb mb gb tb hz khz mhz ghz w kw v a").split()
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()


def _known(list_of_words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in list_of_words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(w) for w in raw])
    return np.sort(Prefix(data).slice(end - [len(w) for w in raw], end))


def _one_of(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h if len(known) else np.zeros(len(h), bool)


_UNITS, _NUMBERS = _known(UNITS), _known(NUMBERS)


def template_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, value) of every token; kind 0 is a plain word, value the hash of the lower-cased token."""
    return _tokens(data, off)[:3]


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``template_tokens``, and whether a token is a plain word that opens a sentence with a capital (perhaps a name)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, U64), np.zeros(0, bool)
    nxt, prv = np.append(data[1:], 0).astype(np.uint8), np.concatenate([[0], data[:-1]]).astype(np.uint8)
    digit = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    # Latin-1 signs (C2 xx) and general punctuation (E2 80 xx, E2 81 xx) are no letters
    sign = (data == 0xC2) | ((data == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)))
    if sign.any():
        at = np.flatnonzero(sign)
        for k in (0, 1, 2):
            own = at[(data[at] == 0xE2) | (k < 2)] + k
            letter[own[own < n]] = False
    head = np.zeros(n, bool)
    head[off[:-1][off[:-1] < off[1:]]] = True
    inner = ((data == 44) | (data == 46)) & ~head
    inner[1:-1] &= digit[:-2] & digit[2:] & ~head[2:]
    inner[[0, -1]] = False
    digit |= inner
    high = (prv == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    lower = data + (upper | high).astype(np.uint8) * np.uint8(32)
    kind = digit.astype(np.int8) + 2 * letter.astype(np.int8)
    before = np.concatenate([[0], kind[:-1]])
    first = (kind > 0) & ((kind != before) | head)
    last = (kind > 0) & ((kind != np.append(kind[1:], 0)) | np.append(head[1:], True))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    value = Prefix(lower).slice(start, end)
    out = np.zeros(len(start), np.int8)
    out[digit[start] | _one_of(value, _NUMBERS)] = NUMBER
    capital = upper[start] | ((data[start] == 0xC3) & (nxt[start] >= 0x80) & (nxt[start] <= 0x9E))
    if len(start) > 1:
        behind = np.concatenate([[False], (out[:-1] == NUMBER) & (row[1:] == row[:-1])])
        out[behind & (out == 0) & _one_of(value, _UNITS)] = UNIT
        stops = np.concatenate([[0], np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10) | (data == 58))])
        inside = np.concatenate([[False], (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])])
        out[inside & capital & (out == 0)] = NAME
    return row, out, value, capital & (out == 0)


def template_windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[tuple, np.ndarray, np.ndarray]:
    """((row, position in the row, hash, token index, form) of every window in its forms, kinds of every form, values).

    The forms: names as plain words, names typed (only of windows with a name), and words that
    open a sentence with a capital typed as names too (only of windows with one)."""
    row, kind, value, opening = _tokens(data, off)
    kinds = np.stack([np.where(kind == NAME, 0, kind), kind, np.where(opening, NAME, kind)]).astype(np.uint8)
    if len(row) < size:
        z = np.zeros(0, np.int64)
        return (z, z, z.astype(U64), z, z), kinds, value
    at = np.flatnonzero(row[size - 1:] == row[:-(size - 1)])
    first = np.searchsorted(row, np.arange(len(off) - 1))
    out = []
    for form, need in enumerate((None, kind == NAME, opening)):
        own = at
        if need is not None:
            n = np.concatenate([[0], np.cumsum(need)])
            own = at[n[at + size] > n[at]]
        code = np.where(kinds[form] > 0, kinds[form].astype(U64), value)
        # a polynomial of the window's codes (mixed hashes or kinds) for every token at once, mixed where a window is wanted
        total = code[:len(code) - size + 1].copy()
        for k in range(1, size):
            total *= U64(MULT)
            total += code[k:len(code) - size + 1 + k]
        out.append((row[own], own - first[row[own]], mix(total[own]), own, np.full(len(own), form)))
    return tuple(np.concatenate(c) for c in zip(*out)), kinds, value


WINDOWS = "th long, pos int, h long, kinds binary, slots array<long>"


def _windows(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """Windows of ``texts`` (columns k, t) as rows (k, th = hash of the text, pos, h, kinds and values of the slots)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:  # most windows fail on one look at the first bits of their hash
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[wanted.view(U64) >> U64(64 - SIEVE_BITS)] = True
        for batch in it:
            for part in slices(batch, "t"):
                data, off = utf8(part.column("t"))
                (row, pos, h, at, form), kinds_of, value = template_windows(data, off)
                text_hash = Prefix(data).slice(off[:-1], off[1:])
                if wanted is not None and len(h):
                    hit = np.flatnonzero(sieve[h >> U64(64 - SIEVE_BITS)])
                    hit = hit[_one_of(h[hit], wanted)]
                    row, pos, h, at, form = row[hit], pos[hit], h[hit], at[hit], form[hit]
                if not len(h):
                    continue
                places = at[:, None] + np.arange(WINDOW)
                kinds = kinds_of[form[:, None], places]
                slots = np.where(kinds > 0, value[places], 0).astype(np.int64)
                cols = [part.column("k").take(pa.array(row)), pa.array(text_hash[row].astype(np.int64)), pa.array(pos, pa.int32()), pa.array(h.astype(np.int64)),
                        pa.array([x.tobytes() for x in kinds], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(h) + 1, WINDOW), pa.int32()), pa.array(slots.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "th", "pos", "h", "kinds", "slots"])

    return texts.mapInArrow(run, f"k long, {WINDOWS}")


def _aligned(pdf: pd.DataFrame, share: float) -> tuple[int, int, int] | None:
    """(windows of the item found, first and last place) in the best place of one document, slots consistent; None if too few.

    ``pdf``: matches (pos in the document, ipos in the item, total, kinds, slots, islots).
    """
    total = int(pdf["places"].iloc[0])
    drift = max(3, total // 5)
    diagonal = (pdf["pos"] - pdf["ipos"]).to_numpy()
    best = None
    for start in np.unique(diagonal // drift).tolist():
        own = pdf[(diagonal // drift == start) | (diagonal // drift == start + 1)]
        if own["ipos"].nunique() < share * total:
            continue
        # what each value of the item stands for, by majority over the matched windows
        kinds = np.frombuffer(b"".join(own["kinds"]), np.uint8)
        slots, islots = (np.concatenate(own[c].tolist()) for c in ("slots", "islots"))
        typed = np.flatnonzero(kinds > 0)
        good = np.ones(len(own), bool)
        if len(typed):
            pairs = pd.DataFrame({"kind": kinds[typed], "a": islots[typed], "b": slots[typed]}).value_counts().reset_index()
            pairs = pairs.sort_values(["count", "kind", "a", "b"], ascending=[False, True, True, True])
            pairs = pairs[~pairs.duplicated(["kind", "a"])]
            pairs = pairs[~pairs.duplicated(["kind", "b"])]
            ok = set(zip(pairs["kind"], pairs["a"], pairs["b"]))
            bad = [i for i in typed if (kinds[i], islots[i], slots[i]) not in ok]
            good[np.unique(np.array(bad, np.int64) // WINDOW)] = False
        n = own.loc[good, "ipos"].nunique()
        if n >= share * total and (best is None or n > best[0]):
            best = (n, int(own.loc[good, "pos"].min()), int(own.loc[good, "pos"].max()) + WINDOW)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, start_token, end_token): one row per contaminated document and item."""
    items = benchmark.select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t")).distinct()
    item_windows = _windows(items, None)
    per_item = item_windows.groupBy("k", "th").agg(F.countDistinct("pos").alias("places"))
    right = item_windows.join(per_item, ["k", "th"]).select(
        F.col("k").alias("item"), F.col("th").alias("ith"), F.col("pos").alias("ipos"), "h", F.col("slots").alias("islots"), "places")
    distinct = item_windows.select("h").distinct()
    wanted = None
    if distinct.limit(MAX_LOCAL + 1).count() <= MAX_LOCAL:
        wanted = np.sort(distinct.toArrow().column("h").to_numpy().astype(U64))
    d = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    hits = _windows(d, wanted).select(F.col("k").alias("doc"), "th", "pos", "h", "kinds", "slots")
    pairs = hits.join(right, "h")
    # enough different windows of the item anywhere in the text, counted before the places are compared
    enough = (pairs.groupBy("doc", "th", "item", "ith").agg(F.countDistinct("ipos").alias("n"), F.max("places").alias("_p"))
              .filter(F.col("n") >= share * F.col("_p")))
    chosen = pairs.join(enough.drop("n", "_p").withColumnsRenamed({"doc": "_d", "th": "_t", "item": "_i", "ith": "_j"}),
                        F.col("doc").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & F.col("item").eqNullSafe(F.col("_i")) & (F.col("ith") == F.col("_j")), "left_semi")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = _aligned(pdf, share)
        cols = ["doc_id", "item_id", "matched", "item_windows", "start_token", "end_token"]
        if got is None:
            return pd.DataFrame(columns=cols)
        none = lambda x: None if x is None or pd.isna(x) else int(x)
        return pd.DataFrame([[none(key[0]), none(key[2]), got[0], int(pdf["places"].iloc[0]), got[1], got[2]]], columns=cols)

    return (chosen.groupBy("doc", "th", "item", "ith").applyInPandas(
        place, "doc_id long, item_id long, matched int, item_windows int, start_token int, end_token int")
        .groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_windows", "start_token", "end_token")).alias("m"))
        .select("doc_id", "item_id", "m.*"))
