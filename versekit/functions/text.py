"""Scalar text functions (Column -> Column), all JVM-side built-ins.

Every function here is a composition of ``pyspark.sql.functions`` so it stays
inside whole-stage code generation; none of them needs a Python worker.
The cleaning order of ``clean_text`` is the order of the original line
cleaner: lower, character maps, digits glued to a word at line end, ordered
contraction expansion, bracket annotations, punctuation, whitespace split,
stop-word removal.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata

# Whitespace as Python's str.split() sees it, written with \x{..} escapes that
# both java.util.regex and RE2 understand.
WS_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_SPLIT = WS_CLASS + "+"
#: The characters of WS_CLASS.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Digits glued to a word at the end of a line (page counters).
LINE_END_DIGITS = r"([a-z])[0-9]+(\n|$)"
BRACKETED = r"\[[^\n]+\]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def map_chars(col: Column | str) -> Column:
    """lower-case, then the two fixed character conversion tables (composed into one pass)."""
    src, dst = refdata.composed_char_map()
    return F.translate(F.lower(_c(col)), src, dst)


def _replace_chain(c: Column, pairs, word_boundary: bool) -> Column:
    for key, repl in pairs:
        if word_boundary:
            c = F.regexp_replace(c, r"\b" + _re_escape(key) + r"\b", repl.replace("$", r"\$"))
        else:
            c = F.replace(c, F.lit(key), F.lit(repl))
    return c


def expand_contractions(col: Column | str,
                        contractions: Sequence[tuple[str, str]] | None = None,
                        word_boundary: bool = False) -> Column:
    """Ordered literal substring expansion (keys match inside words, as in the original).

    When no replacement value contains an apostrophe, a text without one can
    only ever match the apostrophe-free keys, so such texts run the short
    chain of those keys (same relative order) — the result is identical and
    most texts skip most of the passes."""
    c = _c(col)
    pairs = list(contractions if contractions is not None else refdata.CONTRACTIONS)
    if any("'" in v for _, v in pairs):
        return _replace_chain(c, pairs, word_boundary)
    plain = [(k, v) for k, v in pairs if "'" not in k]
    return _once(c, lambda t: F.when(F.instr(t, "'") > 0, _replace_chain(t, pairs, word_boundary))
                 .otherwise(_replace_chain(t, plain, word_boundary)))


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def drop_short_lines(col: Column | str, min_chars: int = refdata.MIN_LINE_CHARS) -> Column:
    """Blank out every line with fewer than ``min_chars`` characters (newline excluded)."""
    # (?d): only \n ends a line, matching Python's reader on '\n'-separated text.
    return F.regexp_replace(_c(col), r"(?dm)^[^\n]{0,%d}$" % (min_chars - 1), "")


def clean_text(col: Column | str,
               contractions: Sequence[tuple[str, str]] | None = None,
               word_boundary: bool = False) -> Column:
    """Steps 1-7 of the line cleaner on a line or a whole multi-line text."""
    c = map_chars(col)
    c = F.regexp_replace(c, LINE_END_DIGITS, "$1$2")
    c = expand_contractions(c, contractions, word_boundary)
    c = F.regexp_replace(c, BRACKETED, "")
    return F.translate(c, refdata.PUNCTUATION, "")


def _once(c: Column, f) -> Column:
    """f(c) with ``c`` evaluated once, however often ``f`` names it: inside a lambda Spark shares no common parts."""
    return F.transform(F.array(c), f)[0]


def split_ws(col: Column | str) -> Column:
    """Whitespace split without empty tokens (Python ``str.split()``)."""
    return F.filter(F.split(_c(col), WS_SPLIT), lambda w: w != F.lit(""))


def remove_stops(arr: Column, stops: Iterable[str]) -> Column:
    """Drop stop words from a token array keeping duplicates and order."""
    stops = list(dict.fromkeys(stops))
    if not stops:
        return arr
    return F.filter(arr, lambda w: ~w.isin(stops))


def clean_tokens(col: Column | str, stops: Iterable[str] | None = None,
                 contractions: Sequence[tuple[str, str]] | None = None,
                 word_boundary: bool = False) -> Column:
    """Cleaned word tokens of a line (or of a text whose lines are all used)."""
    stops = refdata.CORESTOPS if stops is None else stops
    # every space is a blank first, so the split needs no pattern; empty parts are filtered out
    spaced = F.translate(clean_text(col, contractions, word_boundary), WS_CHARS, " " * len(WS_CHARS))
    words = F.filter(F.split(spaced, " "),
                     lambda w: (w != F.lit("")) & ~w.isin(list(dict.fromkeys(stops))))
    return words


def clean_string(col: Column | str, stops: Iterable[str] | None = None) -> Column:
    """The cleaned tokens joined by one space."""
    return F.array_join(clean_tokens(col, stops), " ")


def document_tokens(text: Column | str, stops: Iterable[str] | None = None) -> Column:
    """Tokens of a whole track text: short raw lines skipped, every other line cleaned."""
    return clean_tokens(drop_short_lines(text), stops)


# --------------------------------------------------------------------------- T3

def normalize_markers(text: Column | str, marker: str = refdata.TRACK_MARKER) -> tuple[Column, Column]:
    """(normalised text, status) using the first matching rule of the cascade.

    1. embed text present -> replaced by the marker line
    2. lower-case ``songbreak`` present -> replaced by the marker line
    3. marker already present -> unchanged
    4. a blank line followed by a newline -> replaced by the marker line
    5. otherwise status 13 and text unchanged.
    Blank lines are then removed (rules 1-4).  Status 0 means success.
    """
    t = _c(text)
    eot = "\n" + marker + "\n"
    embed = refdata.EMBED_MARKER
    converted = (
        F.when(F.instr(t, embed) > 0, F.replace(t, F.lit(embed), F.lit(eot)))
        .when(F.instr(t, "songbreak") > 0, F.replace(t, F.lit("songbreak"), F.lit(eot)))
        .when(F.instr(t, marker) > 0, t)
        .when(t.rlike(r"(?dm)^\n\n"), F.regexp_replace(t, r"(?dm)^\n\n", eot))
    )
    status = F.when(converted.isNull(), F.lit(13)).otherwise(F.lit(0))
    cleaned = F.regexp_replace(converted, r"(?dm)^\n", "")
    return F.coalesce(cleaned, t), status


# --------------------------------------------------------------------------- T4/T5

def clean_name(col: Column | str) -> Column:
    """T4: character maps, then spaces removed."""
    src, dst = refdata.composed_char_map()
    return F.replace(F.translate(_c(col), src, dst), F.lit(" "), F.lit(""))


def file_safe_name(col: Column | str) -> Column:
    """T5: drop spaces, dots and apostrophes; slash and en dash become '-'."""
    c = F.translate(_c(col), "/–", "--")
    return F.translate(c, " .'", "")


# --------------------------------------------------------------------------- T6-T11

def extract_words(col: Column | str, stops: Iterable[str]) -> Column:
    """Non-word characters -> space, split, lower, drop stops, joined with a leading space."""
    toks = F.transform(split_ws(F.regexp_replace(_c(col), r"[^\p{L}\p{N}_]", " ")), lambda w: F.lower(w))
    toks = remove_stops(toks, stops)
    return F.concat(F.when(F.size(toks) > 0, F.lit(" ")).otherwise(F.lit("")), F.array_join(toks, " "))


def double_stops(arr: Column, stop1: Iterable[str] | None = None,
                 stop2: Iterable[str] | None = None) -> Column:
    """Two successive stop lists on a token array (duplicates survive)."""
    s1 = refdata.GS_STOP if stop1 is None else stop1
    out = remove_stops(arr, s1)
    if stop2 is not False:
        out = remove_stops(out, refdata.STOP_LYRICS if stop2 is None else stop2)
    return out


def scrub_text(col: Column | str) -> Column:
    """Newline and '.' -> space, non-ASCII dropped, alphabetic tokens of 2+ chars, lower."""
    c = F.translate(_c(col), "\n.", "  ")
    c = F.regexp_replace(c, r"[^\x{00}-\x{7F}]", "")
    toks = F.filter(split_ws(c), lambda w: (F.length(w) >= 2) & w.rlike("^[A-Za-z]+$"))
    return F.transform(toks, lambda w: F.lower(w))


def min_len_tokens(arr: Column, min_len: int = 4) -> Column:
    """Keep tokens with at least ``min_len`` characters (more than 3 by default)."""
    return F.filter(arr, lambda w: F.length(w) >= min_len)


def title_tokens(title: Column | str, with_joined: bool = False) -> Column:
    """Cleaned title tokens, optionally plus the title joined as one token."""
    toks = clean_tokens(title)
    if with_joined:
        joined = F.array_join(toks, "")
        return F.when(F.size(toks) > 0, F.concat(toks, F.array(joined))).otherwise(toks)
    return toks
