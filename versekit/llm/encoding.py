"""Token ids of whole texts with the ``tokenizers`` library, fast on repeated words.

A pre-tokenizer that never joins a chunk to what follows makes the ids of a
text the concatenation of its chunks' ids, so chunks are encoded once and
remembered.  The memory is a cache of bounded size: two generations of
``CACHE_CHUNKS``, of which the older is dropped when the younger is full (what
is met again moves over); results do not depend on it.

* ``byte_bpe_50k.json`` (byte-level, a space belongs to the word after it):
  a text may be cut before every single space that precedes a non-space.
* ``word_bpe_49k.json`` (white space dropped): it may be cut at blanks, line
  feeds, tabs and carriage returns.

Ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``:
by the library's defaults the string of a special token, where a text holds it, is that token.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 350_000
LONGEST_CHUNK = 64
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))

_BEFORE_SPACE = re.compile(r"(?= \S)")
#: A word of ASCII and Latin-1 letters (with its space) and up to eight signs without an apostrophe, as Arrow's expressions have it.
_WORD_AND_SIGNS = r"^(?P<word> ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[-.,!?;:$%&*#|]{0,8})$"

#: As Arrow's expressions have it: a blank before any white space of Unicode, or at the end.
_BLANK_AND_SPACE = r" (?:[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


def _escaped(literal: str) -> str:
    """A string as an expression of Arrow's."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in literal)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_chunks(text: str) -> list[str]:
    """Chunks of a text for a byte-level tokenizer; their concatenation is the text."""
    return [x for x in _BEFORE_SPACE.split(text) if x]


def word_chunks(text: str) -> list[str]:
    """White-space separated chunks; blanks themselves give no token."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Encoder:
    """Encodes batches of texts into arrays of unsigned 32-bit ids."""

    def __init__(self, path: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # the library takes the strings of added tokens out of a text first, and encodes what stands between them on its own
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.chunks, self.words = word_chunks if words else byte_chunks, words
        # texts that are not cut at every blank: white space behind a blank, a blank at the end, an added token
        self.cut_singly = "|".join([*(map(_escaped, added)), *([] if words else [_BLANK_AND_SPACE])]) or r"[^\x00-\x{10FFFF}]"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        from tokenizers.pre_tokenizers import ByteLevel
        # how the library writes each letter's bytes; lower-cased where its normalizer does that
        written = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): written.pre_tokenize_str(c.lower() if words else c)[0][0] for c in LETTERS + " "}
        self.model = self.tokenizer.model

    def _cut(self, text: str) -> list[str]:
        """Chunks of a text; an added token's string is one of its own."""
        if self.added is None or not self.added.search(text):
            return self.chunks(text)
        return [c for i, part in enumerate(self.added.split(text)) if part for c in ([part] if i % 2 else self.chunks(part))]

    def _plain(self, x: str) -> bytes:
        """Ids of one pre-token of plain letters, from the vocabulary model itself."""
        return array("I", [t.id for t in self.model.tokenize(x.translate(self.letters))]).tobytes()

    def _ids(self, parts: list[str], plain: bool) -> list[bytes]:
        """Ids of distinct parts: of ``plain`` words by the model itself, of others by the whole tokenizer."""
        known, out, new = self.known, list(map(self.known.get, parts)), []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self.old.get(parts[i])
            if out[i] is not None:
                known[parts[i]] = out[i]
            else:
                new.append(i)
        if plain:
            got = [self._plain(parts[i]) for i in new]
        else:
            got = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([parts[i] for i in new], add_special_tokens=False)]
        for i, ids in zip(new, got):
            out[i] = ids
            if len(parts[i]) <= LONGEST_CHUNK:
                known[parts[i]] = ids
        return out

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct chunks, place there of every chunk, chunks of every text).

        Texts that may be cut at every blank are cut by Arrow, which numbers equal
        words; the others, and the first words of byte-level texts, are cut one by one."""
        singly = pc.match_substring_regex(texts, self.cut_singly).to_numpy(zero_copy_only=False)
        usual = texts.filter(pa.array(~singly))
        if self.words:
            usual = pc.replace_substring_regex(usual, "[\n\t\r]", " ")
        cut = pc.split_pattern(usual, " ")
        n = np.zeros(len(texts), np.int64)
        n[~singly] = pc.list_value_length(cut).to_numpy()
        numbered = cut.flatten().dictionary_encode()
        distinct, own = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        place: dict[str, int] = {}
        if not self.words:
            heads = np.cumsum(n[~singly]) - n[~singly]
            own[heads] = [place.setdefault(x, len(distinct) + len(place)) for x in distinct.take(pa.array(own[heads])).to_pylist()]
            distinct = pc.binary_join_element_wise(" ", distinct, "")
        others = []
        for i in np.flatnonzero(singly).tolist():
            got = self._cut(texts[i].as_py())
            n[i] = len(got)
            others += [place.setdefault(c, len(distinct) + len(place)) for c in got]
        if others:
            both, of_singly = np.empty(n.sum(), np.int64), np.repeat(singly, n)
            both[of_singly], both[~of_singly] = others, own
            own = both
        return pa.concat_arrays([distinct, pa.array(list(place), pa.string())]), own, n

    def encode_flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each); a null text has none but ``end``, which follows every text."""
        if len(self.known) > CACHE_CHUNKS:
            self.old, self.known = self.known, {}
        distinct, own, n = self._chunks(texts.fill_null(""))
        # a word of plain letters and the signs behind it are two pre-tokens
        parts = pc.extract_regex(distinct, _WORD_AND_SIGNS)
        is_word = parts.is_valid()
        word, sign = (parts.filter(is_word).field(k).dictionary_encode() for k in (0, 1))
        lists = [_strings(x) for x in (word.dictionary, sign.dictionary, distinct.filter(pc.invert(is_word)))]
        ids = [b for x, plain in zip(lists, (True, False, False)) for b in self._ids(x, plain)] + [b""]
        is_word = is_word.to_numpy(zero_copy_only=False)
        pair = np.full((len(distinct), 2), len(ids) - 1)
        pair[is_word, 0], pair[is_word, 1] = word.indices, sign.indices.to_numpy() + len(lists[0])
        pair[~is_word, 0] = np.arange(len(lists[2])) + len(lists[0]) + len(lists[1])
        held, size = _joined(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, pair.ravel())
        size = size.reshape(-1, 2).sum(axis=1)
        if end is not None:
            held, size, n = np.append(held, np.uint32(end)), np.append(size, 1), n + 1
            with_end = np.full(n.sum(), len(size) - 1)
            inner = np.ones(len(with_end), bool)
            inner[np.cumsum(n) - 1] = False
            with_end[inner] = own
            own = with_end
        flat, each = _joined(held, size, own)
        total = np.concatenate([[0], np.cumsum(each)])
        return flat, np.diff(total[np.concatenate([[0], np.cumsum(n)])])

    def encode(self, texts: list[str | None] | pa.Array, end: int | None = None) -> list[np.ndarray]:
        """Ids of every text (null: none), followed by ``end``."""
        flat, sizes = self.encode_flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end)
        cut = np.cumsum(sizes).tolist()
        return [flat[a:b] for a, b in zip([0, *cut], cut)]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _joined(held: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the runs at ``places``; run k of ``held`` is ``size[k]`` values long."""
    start, each = np.cumsum(size) - size, size[places]
    before = np.cumsum(each) - each
    return held[np.repeat(start[places] - before, each) + np.arange(each.sum())], each


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """The worker's encoder of a vocabulary file; it and its cache outlive a task."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]
