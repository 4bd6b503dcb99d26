"""Token ids as one wavelet-matrix file per shard.

A file holds the ids of consecutive documents (ascending id) as bit planes from
the highest bit down: plane b stores bit b of every id in the order that a
stable partition by the higher bits gives.  With the number of ones before
every 512th bit, rank is a look-up and a popcount, so one file answers access
(which id stands at a place), counting (how often an id occurs before a place)
and occurrence look-up (where its n-th occurrence stands) without decoding.

Layout: ``WVM1``, then the length of a JSON header (4 bytes), the header (counts,
bit width, zeros per plane, and place and size of each section), then the sections,
each a zstd frame: document ids, document ends, and per plane its bits and its rank
directory.  A file is written under a temporary name and then moved, so a task
that is repeated leaves one whole file.

Documents with a null id come first; a null or empty text is the end id alone;
repeated rows are written each; an empty table gives no file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versekit.llm.encoding import encoder, tokenizer_path
from versekit.llm.store import keep, shared_path
from versekit.llm.textbuf import slices

MAGIC, BLOCK = b"WVM1", 512
#: Bytes of text that are encoded at a time; what they hold twice is looked up once.
SLICE = 2 << 20
NO_ID = -(1 << 63)
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def write_matrix(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file's bytes for a shard's ids, its documents' ids and where each document ends."""
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=1).compress
    n, width = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16 if width <= 16 else np.uint32)
    sections, zeros = [squeeze(doc_ids.astype("<i8").tobytes()), squeeze(ends.astype("<i8").tobytes())], []
    for b in range(width - 1, -1, -1):
        one = (cur & cur.dtype.type(1 << b)) != 0
        bits = np.packbits(one, bitorder="little")
        heads = np.zeros(-(-n // BLOCK) + 1, "<u4")
        per = np.zeros((len(heads) - 1) * BLOCK // 8, np.uint8)
        per[:len(bits)] = np.bitwise_count(bits)
        np.cumsum(per.reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32), out=heads[1:])
        sections += [squeeze(bits.tobytes()), squeeze(heads.tobytes())]
        zeros.append(int(n - heads[-1]))
        cur = np.concatenate([cur.compress(~one), cur.compress(one)])
    places = np.concatenate([[0], np.cumsum([len(s) for s in sections])]).tolist()
    head = json.dumps({"n": n, "docs": len(doc_ids), "width": width, "zeros": zeros, "places": places}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class WaveletFile:
    """Reader of one file; sections are decompressed when first needed."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = int.from_bytes(raw[4:8], "little")
        self.head = json.loads(raw[8:8 + size])
        self.raw, self.base, self.have = memoryview(raw), 8 + size, {}
        self.n, self.width, self.zeros = self.head["n"], self.head["width"], self.head["zeros"]

    def section(self, i: int, kind: str) -> np.ndarray:
        if i not in self.have:
            import zstandard
            a, b = self.head["places"][i:i + 2]
            self.have[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[self.base + a:self.base + b]), kind)
        return self.have[i]

    @property
    def doc_ids(self) -> np.ndarray:
        return self.section(0, "<i8")

    @property
    def ends(self) -> np.ndarray:
        return self.section(1, "<i8")

    def _rank(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        bits, heads = self.section(2 + 2 * plane, "u1"), self.section(3 + 2 * plane, "<u4")
        block = at // BLOCK
        part = bits[block * BLOCK // 8:(at + 7) // 8]
        ones = int(np.bitwise_count(part[:(at - block * BLOCK) // 8]).sum())
        if at % 8:
            ones += (int(part[-1]) & ((1 << at % 8) - 1)).bit_count()
        return int(heads[block]) + ones

    def _bit(self, plane: int, at: int) -> int:
        return int(self.section(2 + 2 * plane, "u1")[at // 8]) >> at % 8 & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for p in range(self.width):
            bit = self._bit(p, at)
            at = self.zeros[p] + self._rank(p, at) if bit else at - self._rank(p, at)
            value = value << 1 | bit
        return value

    def _down(self, value: int, at: int) -> list[tuple[int, int]]:
        """(first, place) of ``value``'s range in every plane's order, before place ``at``."""
        a, out = 0, []
        for p in range(self.width):
            if value >> (self.width - 1 - p) & 1:
                a, at = self.zeros[p] + self._rank(p, a), self.zeros[p] + self._rank(p, at)
            else:
                a, at = a - self._rank(p, a), at - self._rank(p, at)
            out.append((a, at))
        return out

    def count(self, value: int, before: int | None = None) -> int:
        """Occurrences of an id before a place (default: in the file)."""
        if value >> self.width:
            return 0
        a, b = self._down(value, self.n if before is None else before)[-1]
        return b - a

    def locate(self, value: int, nth: int) -> int:
        """Place of the ``nth`` occurrence (from 0) of an id."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        at = self._down(value, 0)[-1][0] + nth
        for p in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - p) & 1
            at = self._select(p, at - self.zeros[p] if one else at, one)
        return at

    def _select(self, plane: int, nth: int, one: int) -> int:
        """Place of the ``nth`` one (or zero) of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            r = self._rank(plane, mid + 1)
            lo, hi = (mid + 1, hi) if (r if one else mid + 1 - r) <= nth else (lo, mid)
        return lo

    def ids(self) -> np.ndarray:
        """All ids, decoded plane by plane from the lowest."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for p in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.section(2 + 2 * p, "u1"), count=self.n, bitorder="little").astype(bool)
            self.have.pop(2 + 2 * p)
            out = np.empty_like(cur)
            out[~one] = cur[:self.zeros[p]]
            out[one] = cur[self.zeros[p]:] | kind(1 << (self.width - 1 - p))
            cur = out
        return cur


def _store(path: str, data: bytes) -> None:
    system, place = fs.FileSystem.from_uri(path)
    part = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, place)


def read_file(path: str) -> WaveletFile:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as f:
        return WaveletFile(f.read())


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = 32 << 20, vocabulary: str | None = None, doc_id: str = "doc_id",
                 text: str = "text", end: int = 0) -> DataFrame:
    """Write the files of ``docs`` into ``folder`` (a uri); returns the manifest (shard, path, n_docs, n_tokens).

    Shards are ranges of ascending document ids with about ``shard_bytes`` of
    text; a task holds one shard.  The manifest is kept, so files are written once.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, ids, own, sizes = encoder(path, words=False), TaskContext.get().partitionId(), [], [], []
        for batch in it:
            for part in slices(batch, "t", SLICE):
                got, n = enc.encode_flat(part.column("t"), end)
                ids.append(got.astype(np.uint16 if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32))
                sizes += n.tolist()
                own += [NO_ID if d is None else d for d in part.column("d").to_pylist()]
        if own:
            all_ids = np.concatenate(ids)
            ids.clear()
            to = f"{folder}/shard-{shard:06d}.wvm"
            _store(to, write_matrix(all_ids, np.array(own, np.int64), np.cumsum(sizes)))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": pa.array([to]),
                                              "n_docs": pa.array([len(own)], pa.int64()), "n_tokens": pa.array([len(all_ids)], pa.int64())})

    ordered = rows.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("d")).sortWithinPartitions("d", "t")
    return keep(ordered.mapInArrow(write, MANIFEST), "wavelet-manifest")[0]


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_from", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("_from").to_pylist()):
                f = read_file(path)
                ids, ends = f.ids(), f.ends
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                d = f.doc_ids
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64(), mask=d == NO_ID), "start": pa.array(starts + base, pa.int64()),
                                                  "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # a task for each file: the number of partitions is given, so that they are not merged
    spread = files.select("shard", "path", "_from").repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Files in the session's shared folder, read back."""
    return read_shards(write_shards(docs, shared_path(docs.sparkSession, "wavelet"), vocabulary=vocabulary))
