"""A bitmap of fixed size that marks the hashes which occur more than once in a table.

Tasks pack what they read (a hash that a task saw again is sent twice, no more),
one task for each hash range adds up, and the bitmap's ranges, ``2^BITMAP_BITS`` bits
whatever the table holds, are written into the session's shared folder (``write_repeated``),
where tasks read them (``held``): the driver has their path alone.  A hash that occurs once
may be marked by chance, one that occurs again always is, so it may drop rows
before a shuffle but decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame

from versekit.llm.store import keep
from versekit.llm.textbuf import U64, slices

BITMAP_BITS = 28
PARTS = 64
HELD = 2_000_000


def _ranges(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], most: int) -> DataFrame:
    """(part, bits): the ranges of the bitmap, packed (zstd)."""
    shift = 32 - (PARTS - 1).bit_length()

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            v = np.repeat(v, np.minimum(n, 2))
            cut = np.searchsorted(v, (np.arange(PARTS + 1) << shift))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["part", "v"])

        for batch in it:
            for part in slices(batch, "t", most) if "t" in batch.schema.names else (batch,):
                held.append((hashes(part) >> U64(32)).astype(np.uint32))
                if sum(map(len, held)) > HELD:
                    yield flush()
        if held:
            yield flush()

    bits_each = (1 << BITMAP_BITS) // PARTS

    def twice(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard
        v = np.sort(np.frombuffer(b"".join(pdf["v"]), np.uint32))
        again = v[1:][v[1:] == v[:-1]] >> (32 - BITMAP_BITS)
        bits = np.zeros(bits_each, bool)
        bits[again.astype(np.int64) - key[0] * bits_each] = True
        return pd.DataFrame({"part": [key[0]], "bits": [zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())]})

    return docs.mapInArrow(pack, "part int, v binary").groupBy("part").applyInPandas(twice, "part int, bits binary")


def mark_repeated(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], most: int = 1 << 20) -> list[bytes]:
    """The bitmap of ``hashes`` (64-bit, of a batch) over all rows of ``docs``; batches are cut by their text column t, if there is one, into ``most`` bytes.

    Its ranges are packed, as tasks made them; ``unpacked`` gives the bitmap.
    """
    out = [b""] * PARTS
    for r in _ranges(docs, hashes, most).collect():
        out[r["part"]] = bytes(r["bits"])
    return out


def write_repeated(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], most: int = 1 << 20) -> str:
    """``mark_repeated`` as a table in the shared folder, for ``held``; nothing of it comes to the driver but its path."""
    return keep(_ranges(docs, hashes, most), "bitmap")[1]


def held(path: str) -> np.ndarray:
    """The bitmap that ``write_repeated`` wrote, in a task."""
    system, place = fs.FileSystem.from_uri(path)
    rows = ds.dataset(place, filesystem=system, format="parquet").to_table(columns=["part", "bits"], use_threads=False)
    out = [b""] * PARTS
    for k, z in zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist()):
        out[k] = z
    return unpacked(out)


def unpacked(ranges: list[bytes]) -> np.ndarray:
    """The bitmap from its packed ranges; nothing is marked in a range that is not there."""
    import zstandard
    each = (1 << BITMAP_BITS) // 8 // PARTS
    out = np.zeros(PARTS * each, np.uint8)
    for i, z in enumerate(ranges):
        if z:
            out[i * each:(i + 1) * each] = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are marked."""
    slot = (hashes >> U64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
