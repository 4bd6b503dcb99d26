"""SQL text for the oracle side (DuckDB dialect).

The statements and patterns are written out here and share no code with the
library's expressions; only the fixed word lists and character tables
(``refdata``) are the same.  They are not executed by the library itself.
"""

from __future__ import annotations

from .. import refdata  # noqa: F401

# patterns, stated here and not taken from the library
LINE_END_DIGITS = r"([a-z])[0-9]+(\n|$)"
BRACKETED = r"\[[^\n]+\]"
WS_SPLIT = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in dict.fromkeys(words)) + "]"


def clean_text_sql(expr: str) -> str:
    src, dst = refdata.char_map_from_to()
    c = f"translate(translate(lower({expr}), {lit(src)}, {lit(dst)}), " \
        f"{lit(refdata.QUOTEDASH_FROM)}, {lit(refdata.QUOTEDASH_TO)})"
    c = f"regexp_replace({c}, {lit(LINE_END_DIGITS)}, '\\1\\2', 'g')"
    for k, v in refdata.CONTRACTIONS:
        c = f"replace({c}, {lit(k)}, {lit(v)})"
    c = f"regexp_replace({c}, {lit(BRACKETED)}, '', 'g')"
    return f"translate({c}, {lit(refdata.PUNCTUATION)}, '')"


def split_ws_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(WS_SPLIT)}), lambda w: w <> '')"


def clean_tokens_sql(expr: str, stops=None) -> str:
    stops = refdata.CORESTOPS if stops is None else stops
    return (f"list_filter(regexp_split_to_array({clean_text_sql(expr)}, {lit(WS_SPLIT)}), "
            f"lambda w: w <> '' AND NOT list_contains({str_list(stops)}, w))")


def drop_short_lines_sql(expr: str) -> str:
    n = refdata.MIN_LINE_CHARS - 1
    return f"regexp_replace({expr}, '(?m)^[^\\n]{{0,{n}}}$', '', 'g')"


def document_tokens_sql(expr: str, stops=None) -> str:
    return clean_tokens_sql(drop_short_lines_sql(expr), stops)


# common CTEs ---------------------------------------------------------------

TRACKS = """tracks AS (
  SELECT doc_id, lang AS genre, source AS artist,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS BIGINT) AS track_no,
         printf('%s_%s%03d', lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) AS dtag
  FROM documents)"""


def doc_words_cte(stops=None) -> str:
    return f"""doc_words AS (
  SELECT doc_id, lang AS genre, source AS artist, {document_tokens_sql('text', stops)} AS words
  FROM documents),
dw AS (
  SELECT doc_id, genre, artist, words, CAST(len(words) AS BIGINT) AS ntok,
         CAST(len(list_distinct(words)) AS BIGINT) AS uniq
  FROM doc_words)"""


COUNTS = """counts AS (
  SELECT d.doc_id, d.genre, d.artist, d.uniq, t.word, CAST(count(*) AS BIGINT) AS cnt
  FROM dw d, unnest(d.words) AS t(word)
  GROUP BY d.doc_id, d.genre, d.artist, d.uniq, t.word)"""

NTOTAL = "(SELECT count(*) FROM documents)"

IDF = f"""idf AS (
  SELECT word, CAST(count(*) AS BIGINT) AS df,
         CAST(floor(ln({NTOTAL} / count(*)) * 10000 + 0.5) AS BIGINT) AS idf4
  FROM counts GROUP BY word)"""

REGSIZE = """regsize AS (
  SELECT lang AS genre, source AS artist, count(*) AS reg_size
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang, source)"""

COVERED = """covered AS (
  SELECT t.doc_id, t.genre, t.artist, t.track_no, t.dtag, r.reg_size
  FROM tracks t JOIN regsize r ON t.genre = r.genre AND t.artist = r.artist
  WHERE t.track_no < r.reg_size)"""


def base_ctes(stops=None, registry: bool = True) -> str:
    parts = [TRACKS, doc_words_cte(stops), COUNTS, IDF]
    if registry:
        parts += [REGSIZE, COVERED]
    return "WITH " + ",\n".join(parts)


TFIDF_ARTIST = """tfidf_artist AS (
  SELECT p.genre, p.artist, p.word, p.mtf4,
         CASE WHEN coalesce(i.idf4, 0) <> 0 THEN (p.mtf4 * i.idf4 + 5000) // 10000
              ELSE CAST(floor(p.mtf4 * ln(""" + NTOTAL + """ / p.reg_size) + 0.5) AS BIGINT) END AS tfidf4
  FROM (SELECT c.genre, c.artist, c.word, max(v.reg_size) AS reg_size,
               (2 * sum((c.cnt * 20000 + c.uniq) // (2 * c.uniq)) + count(*)) // (2 * count(*)) AS mtf4
        FROM counts c JOIN covered v ON c.doc_id = v.doc_id
        GROUP BY c.genre, c.artist, c.word) p
  LEFT JOIN idf i ON p.word = i.word)"""
