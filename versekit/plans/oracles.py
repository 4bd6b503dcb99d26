"""DuckDB oracle SQL for every registered query that SQL can express."""

from __future__ import annotations

from . import sqltext as Q
from .. import refdata  # noqa: F401

ORACLES: dict[str, str] = {}

BASE = Q.base_ctes()

ORACLES["artist_top_terms"] = BASE + ",\n" + Q.TFIDF_ARTIST + """
SELECT genre, artist, rank, word, tfidf FROM (
  SELECT genre, artist, word, tfidf4 / 10000.0 AS tfidf,
         CAST(row_number() OVER (PARTITION BY genre, artist ORDER BY tfidf4 DESC, word) AS BIGINT) AS rank
  FROM tfidf_artist) WHERE rank <= 10"""

ORACLES["clean_tokens"] = "WITH " + Q.doc_words_cte() + """
SELECT doc_id, ntok, array_to_string(words, ' ') AS cleaned FROM dw"""

ORACLES["track_tags"] = "WITH " + Q.TRACKS + """
SELECT doc_id, genre, artist, track_no, dtag FROM tracks"""

ORACLES["word_freq"] = "WITH " + Q.doc_words_cte() + """
SELECT t.word, CAST(count(*) AS BIGINT) AS cnt FROM dw, unnest(dw.words) AS t(word)
GROUP BY t.word HAVING count(*) >= 3"""

ORACLES["track_tf"] = BASE + """
SELECT t.dtag, c.word, c.cnt, c.uniq, ((c.cnt * 20000 + c.uniq) // (2 * c.uniq)) / 10000.0 AS tf
FROM counts c JOIN tracks t ON c.doc_id = t.doc_id"""

ORACLES["idf"] = BASE + """
SELECT word, df, idf4 / 10000.0 AS idf FROM idf"""

ORACLES["tfidf_artist"] = BASE + ",\n" + Q.TFIDF_ARTIST + """
SELECT genre, artist, word, mtf4 / 10000.0 AS mean_tf, tfidf4 / 10000.0 AS tfidf FROM tfidf_artist"""

# --------------------------------------------------------------------------- sources on tables

_LINES = """lns AS (
  SELECT doc_id, lang AS genre, source AS artist, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS line,
         (SELECT max(j) FROM unnest(generate_series(1, len(ls))) AS u(j) WHERE length(ls[j]) >= 5) AS last_i, i
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents) d,
       unnest(generate_series(1, len(ls))) AS t(i)
  WHERE length(ls[i]) >= 5)"""

ORACLES["lines"] = "WITH " + _LINES + """
SELECT doc_id, line_no, (i = last_i) AS eot, CAST(len(tok) AS BIGINT) AS ntok, array_to_string(tok, ' ') AS cleaned
FROM (SELECT *, """ + Q.clean_tokens_sql("line") + """ AS tok FROM lns)"""

_TITLES = """titles AS (
  SELECT doc_id, array_to_string(list_slice(""" + Q.split_ws_sql("string_split(text, chr(10))[1]") + """, 1, 5), ' ') AS title
  FROM documents),
reg AS (
  SELECT t.genre, t.artist, t.dtag, t.doc_id, t.track_no, ti.title
  FROM tracks t JOIN titles ti ON t.doc_id = ti.doc_id
  WHERE t.doc_id IN (SELECT doc_id FROM labels))"""

ORACLES["registry"] = "WITH " + Q.TRACKS + ",\n" + _TITLES + """
SELECT genre, artist, dtag, title FROM reg"""

ORACLES["track_by_tag"] = "WITH " + Q.TRACKS + ",\n" + _TITLES + ",\n" + _LINES + """,
per AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
         string_agg(cleaned, ' | ' ORDER BY line_no) AS lyrics
  FROM (SELECT doc_id, line_no, array_to_string(""" + Q.clean_tokens_sql("line") + """, ' ') AS cleaned FROM lns)
  GROUP BY doc_id)
SELECT t.dtag, r.title, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.lyrics, '') AS lyrics
FROM tracks t LEFT JOIN reg r ON t.doc_id = r.doc_id LEFT JOIN per p ON t.doc_id = p.doc_id"""

ORACLES["titled_tracks"] = "WITH " + Q.TRACKS + ",\n" + _TITLES + ",\n" + Q.doc_words_cte() + """
SELECT r.dtag, CAST(len(w) AS BIGINT) AS ntok, array_to_string(w, ' ') AS words
FROM (SELECT t.dtag, CASE WHEN r.doc_id IS NULL THEN d.words
                         ELSE list_concat(d.words, """ + Q.clean_tokens_sql("r.title") + """) END AS w
      FROM tracks t JOIN dw d ON t.doc_id = d.doc_id LEFT JOIN reg r ON r.doc_id = t.doc_id) r"""

ORACLES["select_corpus"] = """
SELECT doc_id, lang AS genre, source AS artist FROM documents
WHERE lang IN ('de', 'en', 'fr') AND lang NOT IN ('de') AND source NOT IN ('src3', 'src7')"""

ORACLES["genre_artists"] = """
SELECT lang AS genre, source AS artist, CAST(count(*) AS BIGINT) AS n_tracks FROM documents GROUP BY lang, source"""

# --------------------------------------------------------------------------- text on tables

ORACLES["clean_string"] = """
SELECT conv_id, turn, array_to_string(""" + Q.clean_tokens_sql("text") + """, ' ') AS cleaned FROM conversations"""

_EMBED = "EmbedShare URLCopyEmbedCopy"
ORACLES["normalize_markers"] = """
WITH n AS (
  SELECT doc_id, text,
    CASE WHEN strpos(text, '""" + _EMBED + """') > 0 THEN replace(text, '""" + _EMBED + """', chr(10) || 'SONGBREAK' || chr(10))
         WHEN strpos(text, 'songbreak') > 0 THEN replace(text, 'songbreak', chr(10) || 'SONGBREAK' || chr(10))
         WHEN strpos(text, 'SONGBREAK') > 0 THEN text
         WHEN regexp_matches(text, '(?m)^\\n\\n') THEN regexp_replace(text, '(?m)^\\n\\n', chr(10) || 'SONGBREAK' || chr(10), 'g')
    END AS conv
  FROM documents)
SELECT doc_id, CAST(CASE WHEN conv IS NULL THEN 13 ELSE 0 END AS BIGINT) AS status,
       CAST(length(coalesce(regexp_replace(conv, '(?m)^\\n', '', 'g'), text)) AS BIGINT) AS n_chars,
       md5(coalesce(regexp_replace(conv, '(?m)^\\n', '', 'g'), text)) AS md5
FROM n"""

ORACLES["extract_words"] = """
SELECT item_id, CASE WHEN len(t) > 0 THEN ' ' ELSE '' END || array_to_string(t, ' ') AS words
FROM (SELECT item_id, list_filter(list_transform(""" + Q.split_ws_sql("regexp_replace(text, '[^\\p{L}\\p{N}_]', ' ', 'g')") + """,
      lambda w: lower(w)), lambda w: NOT list_contains(""" + Q.str_list(Q.refdata.CORESTOPS) + """, w)) AS t
      FROM benchmark)"""

ORACLES["double_stops"] = """
SELECT conv_id, turn, array_to_string(list_filter(list_filter(""" + Q.split_ws_sql("text") + """,
  lambda w: NOT list_contains(""" + Q.str_list(Q.refdata.GS_STOP) + """, w)),
  lambda w: NOT list_contains(""" + Q.str_list(Q.refdata.STOP_LYRICS) + """, w)), ' ') AS cleaned
FROM conversations"""

ORACLES["scrub_text"] = """
SELECT conv_id, turn, array_to_string(list_transform(list_filter(""" + Q.split_ws_sql(
    "regexp_replace(translate(text, chr(10) || '.', '  '), '[^\\x{00}-\\x{7F}]', '', 'g')") + """,
  lambda w: length(w) >= 2 AND regexp_full_match(w, '[A-Za-z]+')), lambda w: lower(w)), ' ') AS scrubbed
FROM conversations"""

ORACLES["min_len_tokens"] = "WITH " + Q.doc_words_cte() + """
SELECT doc_id, CAST(len(t) AS BIGINT) AS ntok, array_to_string(t, ' ') AS words
FROM (SELECT doc_id, list_filter(words, lambda w: length(w) >= 4) AS t FROM dw)"""

ORACLES["title_tokens"] = "WITH " + Q.TRACKS + ",\n" + _TITLES + """
SELECT dtag, array_to_string(CASE WHEN len(t) > 0 THEN list_append(t, array_to_string(t, '')) ELSE t END, ' ') AS title_tokens
FROM (SELECT dtag, """ + Q.clean_tokens_sql("title") + """ AS t FROM reg)"""

# --------------------------------------------------------------------------- filters / joins

ORACLES["min_count"] = "WITH " + Q.doc_words_cte() + """
SELECT t.word, CAST(count(*) AS BIGINT) AS cnt FROM dw, unnest(dw.words) AS t(word)
GROUP BY t.word HAVING count(*) >= 2"""

ORACLES["filter_extremes"] = BASE + """
SELECT word, df FROM idf WHERE df >= 30 AND df <= 0.5 * """ + Q.NTOTAL

_CUT = """cut AS (
  SELECT genre, artist, CAST(round(quantile_cont(tfidf4, 0.3) * 10, 0) AS BIGINT) AS cut10
  FROM tfidf_artist GROUP BY genre, artist),
im AS (SELECT sum(idf4) AS s, count(*) AS n FROM idf)"""

_POS = """pos AS (
  SELECT d.doc_id, d.genre, d.artist, d.uniq, CAST(t.i - 1 AS BIGINT) AS pos, d.words[t.i] AS word
  FROM dw d, unnest(generate_series(1, len(d.words))) AS t(i))"""

ORACLES["tfidf_filter"] = BASE + ",\n" + Q.TFIDF_ARTIST + ",\n" + _CUT + ",\n" + _POS + """,
keep AS (
  SELECT c.doc_id, c.word FROM counts c
  LEFT JOIN idf i ON c.word = i.word
  LEFT JOIN cut k ON c.genre = k.genre AND c.artist = k.artist
  WHERE CASE WHEN coalesce(i.idf4, 0) <> 0 THEN c.cnt * i.idf4 * 10 > coalesce(k.cut10, 0) * c.uniq
             ELSE c.cnt * (CAST((SELECT s FROM im) AS DOUBLE) / (SELECT n FROM im)) * 10 > CAST(coalesce(k.cut10, 0) * c.uniq AS DOUBLE) END),
kept AS (
  SELECT p.doc_id, list(p.word ORDER BY p.pos) AS w FROM pos p
  WHERE (p.doc_id, p.word) IN (SELECT (doc_id, word) FROM keep)
  GROUP BY p.doc_id)
SELECT t.dtag, CAST(len(k.w) AS BIGINT) AS ntok, array_to_string(k.w, ' ') AS words
FROM kept k JOIN tracks t ON k.doc_id = t.doc_id"""

ORACLES["tfidf_outliers"] = BASE + ",\n" + Q.TFIDF_ARTIST + """,
b AS (SELECT genre, artist, CAST(round(quantile_cont(tfidf4, 0.02) * 100, 0) AS BIGINT) AS lo100,
             CAST(round(quantile_cont(tfidf4, 0.98) * 100, 0) AS BIGINT) AS hi100, count(*) AS vocab
      FROM tfidf_artist GROUP BY genre, artist),
per AS (SELECT t.genre, t.artist, max(b.vocab) AS vocab,
               CAST(sum(CASE WHEN t.tfidf4 * 100 > b.hi100 OR t.tfidf4 * 100 < b.lo100 THEN 1 ELSE 0 END) AS BIGINT) AS removed
        FROM tfidf_artist t JOIN b ON t.genre = b.genre AND t.artist = b.artist GROUP BY t.genre, t.artist)
SELECT genre, artist, CAST(vocab AS BIGINT) AS vocab, removed, ((removed * 2000 + vocab) // (vocab * 2)) / 1000.0 AS removed_frac FROM per"""

ORACLES["extra_training_filter"] = BASE + ",\n" + Q.TFIDF_ARTIST + ",\n" + _POS + """,
kept AS (
  SELECT p.doc_id, list(p.word ORDER BY p.pos) AS w FROM pos p
  JOIN tfidf_artist a ON p.genre = a.genre AND p.artist = a.artist AND p.word = a.word
  WHERE a.tfidf4 > 299 GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(len(k.w), 0) AS BIGINT) AS ntok, coalesce(array_to_string(k.w, ' '), '') AS words
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

ORACLES["rare_words"] = BASE + """,
wa AS (SELECT word, CAST(count(*) AS BIGINT) AS n_artists FROM (SELECT DISTINCT genre, artist, word FROM counts) GROUP BY word),
wf AS (SELECT t.word, CAST(count(*) AS BIGINT) AS cnt FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word HAVING count(*) >= 3),
na AS (SELECT count(*) AS n FROM (SELECT DISTINCT genre, artist FROM counts))
SELECT wa.word, wa.n_artists, wf.cnt FROM wa JOIN wf ON wa.word = wf.word
WHERE wa.n_artists <= floor((SELECT n FROM na) * 0.4 + 0.5) AND wf.cnt > 5"""

ORACLES["registry_join"] = "WITH " + Q.TRACKS + ",\n" + _TITLES + """,
regk AS (SELECT genre, artist, dtag AS reg_tag, title,
                CAST(row_number() OVER (PARTITION BY genre, artist ORDER BY track_no) - 1 AS BIGINT) AS k FROM reg)
SELECT t.doc_id, t.dtag, coalesce(r.reg_tag, t.dtag) AS assigned_tag, r.title
FROM tracks t LEFT JOIN regk r ON t.genre = r.genre AND t.artist = r.artist AND t.track_no = r.k"""

# --------------------------------------------------------------------------- aggregates

ORACLES["corpus_counts"] = "WITH " + Q.doc_words_cte() + """
SELECT genre, artist, CAST(count(*) AS BIGINT) AS n_tracks, CAST(sum(ntok) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN ntok = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_empty, CAST(sum(uniq) AS BIGINT) AS sum_uniq
FROM dw GROUP BY genre, artist"""

ORACLES["vocabulary_size"] = "WITH " + Q.doc_words_cte() + """
SELECT CAST(count(DISTINCT t.word) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_tokens
FROM dw, unnest(dw.words) AS t(word)"""

_ATF = """atf AS (
  SELECT n.genre, n.artist, n.word, n.cnt, d.denom, n.cnt / d.denom AS tf
  FROM (SELECT genre, artist, word, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY genre, artist, word) n
  JOIN (SELECT genre, artist, CAST(sum(uniq) AS BIGINT) AS denom FROM dw GROUP BY genre, artist) d
    ON n.genre = d.genre AND n.artist = d.artist)"""

ORACLES["artist_tf"] = BASE + ",\n" + _ATF + """
SELECT genre, artist, word, cnt, denom, tf FROM atf"""

ORACLES["word_artists"] = BASE + """
SELECT word, CAST(count(*) AS BIGINT) AS n_artists FROM (SELECT DISTINCT genre, artist, word FROM counts) GROUP BY word"""

ORACLES["idf_mean"] = BASE + """
SELECT CAST(sum(idf4) AS BIGINT) AS sum_idf4, CAST(count(*) AS BIGINT) AS n_words,
       sum(idf4) / count(*) / 10000.0 AS idf_mean FROM idf"""

ORACLES["tfidf_track"] = BASE + """,
im AS (SELECT CAST(sum(idf4) AS DOUBLE) / count(*) AS m FROM idf)
SELECT v.dtag, c.word, ((c.cnt * 20000 + c.uniq) // (2 * c.uniq)) / 10000.0 AS tf,
       CASE WHEN coalesce(i.idf4, 0) <> 0 THEN (((c.cnt * 20000 + c.uniq) // (2 * c.uniq)) * i.idf4 + 5000) // 10000
            ELSE CAST(floor(((c.cnt * 20000 + c.uniq) // (2 * c.uniq)) * (SELECT m FROM im) / 10000 + 0.5) AS BIGINT) END / 10000.0 AS tfidf
FROM counts c JOIN covered v ON c.doc_id = v.doc_id LEFT JOIN idf i ON c.word = i.word"""

ORACLES["tfidf_artist_simple"] = BASE + ",\n" + _ATF + """
SELECT a.genre, a.artist, a.word, CAST(floor(a.tf * i.idf4 + 0.5) AS BIGINT) / 10000.0 AS tfidf
FROM atf a JOIN idf i ON a.word = i.word"""

ORACLES["bow"] = "WITH " + Q.doc_words_cte() + ",\n" + Q.COUNTS + """,
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS term_id FROM (
  SELECT t.word FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word HAVING count(*) >= 2))
SELECT c.genre, c.artist, v.term_id, c.word, CAST(sum(c.cnt) AS BIGINT) AS cnt
FROM counts c JOIN vocab v ON c.word = v.word GROUP BY c.genre, c.artist, v.term_id, c.word"""

ORACLES["doc_bow"] = BASE + """,
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS term_id FROM idf
          WHERE df >= 30 AND df <= 0.5 * """ + Q.NTOTAL + """)
SELECT t.dtag, v.term_id, c.word, c.cnt FROM counts c JOIN vocab v ON c.word = v.word JOIN tracks t ON c.doc_id = t.doc_id"""

ORACLES["cloud_weights"] = "WITH " + Q.doc_words_cte() + """
SELECT word, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, word) AS BIGINT) AS rank FROM (
  SELECT t.word, CAST(count(*) AS BIGINT) AS cnt FROM dw, unnest(dw.words) AS t(word)
  WHERE length(t.word) >= 4 AND NOT list_contains(""" + Q.str_list(Q.refdata.STOP_LYRICS) + """, t.word)
  GROUP BY t.word ORDER BY cnt DESC, word LIMIT 120)"""


def _hist_sql(values_cte: str, lo: float) -> str:
    return values_cte + """,
st AS (SELECT genre, artist, median(v) AS med, stddev_pop(v) AS sd FROM vals GROUP BY genre, artist),
bd AS (SELECT genre, artist, """ + repr(lo) + """ AS lo, med + sd * 3 AS hi,
              CAST(round((med + sd * 3 - """ + repr(lo) + """) / 0.0002, 0) + 2 AS BIGINT) AS n_bins FROM st)
SELECT v.genre, v.artist, CAST(least(floor((v.v - b.lo) / ((b.hi - b.lo) / b.n_bins)), b.n_bins - 1) AS BIGINT) AS bin,
       CAST(count(*) AS BIGINT) AS cnt
FROM vals v JOIN bd b ON v.genre = b.genre AND v.artist = b.artist
WHERE b.hi > b.lo AND v.v >= b.lo AND v.v <= b.hi GROUP BY 1, 2, 3"""


ORACLES["tfidf_histogram"] = _hist_sql(BASE + ",\n" + Q.TFIDF_ARTIST + """,
vals AS (SELECT genre, artist, tfidf4 / 10000.0 AS v FROM tfidf_artist)""", 0.0006)

ORACLES["tf_histogram"] = _hist_sql(BASE + ",\n" + _ATF + """,
vals AS (SELECT genre, artist, tf AS v FROM atf)""", 0.002)

ORACLES["compare_histogram"] = BASE + ",\n" + Q.TFIDF_ARTIST + """,
vals AS (SELECT genre, artist, tfidf4 / 10000.0 AS v FROM tfidf_artist),
b AS (SELECT genre, artist, min(v) AS mn, max(v) AS mx FROM vals GROUP BY genre, artist),
bd AS (SELECT genre, artist, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi FROM b)
SELECT v.genre, v.artist, CAST(least(floor((v.v - d.lo) / ((d.hi - d.lo) / 200)), 199) AS BIGINT) AS bin,
       CAST(count(*) AS BIGINT) AS cnt
FROM vals v JOIN bd d ON v.genre = d.genre AND v.artist = d.artist GROUP BY 1, 2, 3"""

ORACLES["train_test_split"] = "WITH " + Q.TRACKS + """
SELECT dtag, CAST(row_number() OVER (ORDER BY genre, artist, track_no) - 1 AS BIGINT) AS ordinal,
       (row_number() OVER (ORDER BY genre, artist, track_no) - 1) % 5 = 0 AS is_test
FROM tracks"""

# --------------------------------------------------------------------------- phrases

def _sents(table: str) -> str:
    if table == "documents":
        return f"SELECT doc_id AS sid, {Q.document_tokens_sql('text')} AS words FROM documents"
    return f"SELECT item_id AS sid, {Q.document_tokens_sql('text')} AS words FROM benchmark"


def _counts_sql(src: str) -> str:
    return f"""uni AS (SELECT t.w AS word, count(*) AS n FROM ({src}) s, unnest(s.words) AS t(w) GROUP BY 1),
bi AS (SELECT s.words[t.i] AS w1, s.words[t.i + 1] AS w2, count(*) AS n12
       FROM ({src}) s, unnest(generate_series(1, len(s.words) - 1)) AS t(i) GROUP BY 1, 2)"""


_SCORE = """phr AS (
  SELECT b.w1, b.w2, b.w1 || '-' || b.w2 AS phrase, CAST(b.n12 AS BIGINT) AS n12, CAST(u1.n AS BIGINT) AS n1,
         CAST(u2.n AS BIGINT) AS n2,
         CAST((b.n12 - 10) * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM bi)) AS DOUBLE) / CAST(u1.n * u2.n AS DOUBLE) AS score
  FROM bi b JOIN uni u1 ON b.w1 = u1.word JOIN uni u2 ON b.w2 = u2.word WHERE b.n12 > 10)"""

_PHR = "WITH " + _counts_sql(_sents("documents")) + ",\n" + _SCORE

ORACLES["phrase_scores"] = _PHR + """
SELECT w1, w2, phrase, n12, n1, n2, score FROM phr WHERE score > 10.0"""

ORACLES["find_phrases"] = _PHR + """,
tb AS (SELECT DISTINCT s.words[t.i] AS w1, s.words[t.i + 1] AS w2
       FROM (""" + _sents("benchmark") + """) s, unnest(generate_series(1, len(s.words) - 1)) AS t(i))
SELECT p.phrase, p.score FROM tb JOIN phr p ON tb.w1 = p.w1 AND tb.w2 = p.w2 WHERE p.score > 10.0"""

_BOTH = "(" + _sents("documents") + " UNION ALL " + _sents("benchmark") + ")"
ORACLES["merge_phrase_counts"] = ("WITH " + _counts_sql(_BOTH.strip("()")).replace(
    f"FROM ({_BOTH.strip('()')})", f"FROM {_BOTH}") + ",\n" + _SCORE + """
SELECT w1, w2, phrase, n12, n1, n2, score FROM phr WHERE score > 10.0""")

ORACLES["phrase_stats"] = _PHR + """
SELECT CAST(count(*) AS BIGINT) AS n_phrases, floor(avg(score) * 1e6 + 0.5) / 1e6 AS mean_score,
       floor(median(score) * 1e6 + 0.5) / 1e6 AS median_score, floor(stddev_pop(score) * 1e6 + 0.5) / 1e6 AS std_score,
       floor(max(score) * 1e6 + 0.5) / 1e6 AS max_score
FROM phr WHERE score > 10.0"""

# --------------------------------------------------------------------------- vectors

_R6 = "floor(({x}) * 1e6 + 0.5) / 1e6"
_U = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e),
cen AS (SELECT label, list(x ORDER BY i) AS c FROM (
          SELECT label, t.i, avg(u.u[t.i]) AS x FROM u, unnest(generate_series(1, len(u.u))) AS t(i) GROUP BY label, t.i)
        GROUP BY label)"""


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


ORACLES["normed_vector"] = "WITH " + _U + """
SELECT vec_id, CAST(len(v) AS BIGINT) AS dim, """ + _R6.format(x="sqrt(list_sum(list_transform(v, lambda y: y * y)))") + """ AS norm FROM u"""

ORACLES["most_similar_vec"] = "WITH " + _U + """
SELECT label, rank, vec_id, """ + _R6.format(x="sim") + """ AS sim FROM (
  SELECT c.label, u.vec_id, """ + _cos("c.c", "u.u") + """ AS sim,
         CAST(row_number() OVER (PARTITION BY c.label ORDER BY """ + _cos("c.c", "u.u") + """ DESC, u.vec_id) AS BIGINT) AS rank
  FROM cen c CROSS JOIN u) WHERE rank <= 10"""

_AN = """a1 AS (SELECT label, min(vec_id) AS a1 FROM e GROUP BY label),
a2 AS (SELECT e.label, min(e.vec_id) AS a2 FROM e JOIN a1 ON e.label = a1.label WHERE e.vec_id > a1.a1 GROUP BY e.label),
nx AS (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS nl FROM a1),
qi AS (SELECT a1.label, a1.a1, a2.a2, n.a1 AS n1 FROM a1 JOIN a2 ON a1.label = a2.label
       JOIN nx ON a1.label = nx.label JOIN a1 n ON nx.nl = n.label),
qv AS (SELECT qi.label, qi.a1, qi.a2, qi.n1, p1.u AS p1, p2.u AS p2, m1.u AS m1 FROM qi
       JOIN u p1 ON qi.a1 = p1.vec_id JOIN u p2 ON qi.a2 = p2.vec_id JOIN u m1 ON qi.n1 = m1.vec_id)"""

ORACLES["analogy"] = "WITH " + _U + ",\n" + _AN + """
SELECT label, rank, vec_id, """ + _R6.format(x="sim") + """ AS sim FROM (
  SELECT label, vec_id, sim, CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS BIGINT) AS rank FROM (
    SELECT q.label, u.vec_id, """ + _cos("list_transform(list_zip(q.p1, q.p2, q.m1), lambda z: z[1] + z[2] - z[3])", "u.u") + """ AS sim
    FROM qv q CROSS JOIN u WHERE u.vec_id NOT IN (q.a1, q.a2, q.n1)))
WHERE rank <= 10"""

ORACLES["analogy_cosmul"] = "WITH " + _U + ",\n" + _AN + """
SELECT label, rank, vec_id, """ + _R6.format(x="score") + """ AS score FROM (
  SELECT label, vec_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS BIGINT) AS rank FROM (
    SELECT q.label, u.vec_id,
           ((1 + """ + _cos("q.p1", "u.u") + """) / 2) * ((1 + """ + _cos("q.p2", "u.u") + """) / 2)
           / ((1 + """ + _cos("q.m1", "u.u") + """) / 2 + 1e-6) AS score
    FROM qv q CROSS JOIN u WHERE u.vec_id NOT IN (q.a1, q.a2, q.n1)))
WHERE rank <= 10"""

ORACLES["odd_one_out"] = "WITH " + _U + """
SELECT label, arg_min(vec_id, struct_pack(s := sim, i := vec_id)) AS vec_id,
       """ + _R6.format(x="min(sim)") + """ AS sim
FROM (SELECT u.label, u.vec_id, """ + _cos("u.v", "c.c") + """ AS sim FROM u JOIN cen c ON u.label = c.label)
GROUP BY label"""

_PAIRS = """pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, """ + _cos("a.v", "b.v") + """ AS sim,
                 CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS human
          FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"""

ORACLES["pair_similarity"] = "WITH " + _U + ",\n" + _PAIRS + """
SELECT a, b, """ + _R6.format(x="sim") + """ AS sim FROM pairs"""

ORACLES["set_similarity"] = "WITH " + _U + """,
hm AS (SELECT label, half, list(x ORDER BY i) AS m FROM (
         SELECT label, vec_id % 2 AS half, t.i, avg(u.u[t.i]) AS x FROM u, unnest(generate_series(1, len(u.u))) AS t(i)
         GROUP BY label, vec_id % 2, t.i) GROUP BY label, half)
SELECT a.label, """ + _R6.format(x=_cos("a.m", "b.m")) + """ AS sim
FROM hm a JOIN hm b ON a.label = b.label AND a.half = 0 AND b.half = 1"""

ORACLES["eval_word_pairs"] = "WITH " + _U + ",\n" + _PAIRS + """,
p6 AS (SELECT sim, human, """ + _R6.format(x="sim") + """ AS sim6 FROM pairs),
rk AS (SELECT (rank() OVER (ORDER BY sim6) - 1) + (count(*) OVER (PARTITION BY sim6) + 1) / 2.0 AS rs,
              (rank() OVER (ORDER BY human) - 1) + (count(*) OVER (PARTITION BY human) + 1) / 2.0 AS rh FROM p6)
SELECT CAST(count(*) AS BIGINT) AS n_pairs, """ + _R6.format(x="corr(sim, human)") + """ AS pearson,
       (SELECT """ + _R6.format(x="corr(rs, rh)") + """ FROM rk) AS spearman FROM pairs"""

ORACLES["vocab_lookup"] = "WITH " + Q.doc_words_cte() + """,
bw AS (SELECT DISTINCT t.w AS word FROM (""" + _sents("benchmark") + """) s, unnest(s.words) AS t(w)),
wf AS (SELECT t.word, CAST(count(*) AS BIGINT) AS cnt FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word)
SELECT b.word, coalesce(wf.cnt, 0) AS cnt, wf.cnt IS NOT NULL AS in_vocab FROM bw b LEFT JOIN wf ON b.word = wf.word"""

ORACLES["similar_docs"] = BASE + """,
qs AS (SELECT s.sid, t.w AS word, CAST(len(list_distinct(s.words)) AS BIGINT) AS uniq
       FROM (""" + _sents("benchmark") + """) s, unnest(s.words) AS t(w)),
qc AS (SELECT sid, uniq, word, count(*) AS cnt FROM qs GROUP BY sid, uniq, word),
qw AS (SELECT q.sid, q.word, (((q.cnt * 20000 + q.uniq) // (2 * q.uniq)) * i.idf4 + 5000) // 10000 AS wq
       FROM qc q JOIN idf i ON q.word = i.word),
dwt AS (SELECT c.doc_id, c.word, (((c.cnt * 20000 + c.uniq) // (2 * c.uniq)) * i.idf4 + 5000) // 10000 AS wd
        FROM counts c JOIN idf i ON c.word = i.word),
qn AS (SELECT sid, sum(wq * wq) AS nq FROM qw WHERE wq > 0 GROUP BY sid),
dn AS (SELECT doc_id, sum(wd * wd) AS nd FROM dwt WHERE wd > 0 GROUP BY doc_id),
dots AS (SELECT q.sid, d.doc_id, sum(q.wq * d.wd) AS dot FROM qw q JOIN dwt d ON q.word = d.word
         WHERE q.wq > 0 AND d.wd > 0 GROUP BY q.sid, d.doc_id),
sims AS (SELECT d.sid, d.doc_id, CAST(d.dot AS DOUBLE) / (sqrt(CAST(qn.nq AS DOUBLE)) * sqrt(CAST(dn.nd AS DOUBLE))) AS sim
         FROM dots d JOIN qn ON d.sid = qn.sid JOIN dn ON d.doc_id = dn.doc_id)
SELECT sid AS item_id, rank, doc_id, sim FROM (
  SELECT sid, doc_id, sim, CAST(row_number() OVER (PARTITION BY sid ORDER BY sim DESC, doc_id) AS BIGINT) AS rank FROM sims)
WHERE rank <= 10"""

ORACLES["cooccurrence"] = BASE + """,
top AS (SELECT t.word FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word ORDER BY count(*) DESC, t.word LIMIT 20),
d AS (SELECT DISTINCT doc_id, word FROM counts WHERE word IN (SELECT word FROM top))
SELECT a.word AS w1, b.word AS w2, CAST(count(*) AS BIGINT) AS n_docs
FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY 1, 2"""

ORACLES["ingest_gate"] = """
SELECT site, page_id, track_no, printf('%s%03d', site, track_no) AS dtag, title FROM (
  SELECT regexp_extract(url, '://([^/]+)', 1) AS site, page_id,
         CAST(row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) - 1 AS BIGINT) AS track_no,
         substring(url, 20, length(url) - 26) AS title
  FROM pages WHERE ends_with(url, 'html') AND length(html) > 80)"""

ORACLES["apply_phrases"] = _PHR + """,
sb AS (""" + _sents("benchmark") + """),
pos AS (SELECT s.sid, t.i - 1 AS pos, s.words[t.i] AS word, s.words[t.i + 1] AS nxt
        FROM sb s, unnest(generate_series(1, len(s.words))) AS t(i)),
cand AS (SELECT p.sid, p.pos FROM pos p JOIN phr f ON p.word = f.w1 AND p.nxt = f.w2 WHERE f.score > 10.0),
runs AS (SELECT sid, pos, pos - row_number() OVER (PARTITION BY sid ORDER BY pos) AS grp FROM cand),
taken AS (SELECT sid, pos FROM (SELECT sid, pos, min(pos) OVER (PARTITION BY sid, grp) AS st FROM runs)
          WHERE (pos - st) % 2 = 0),
toks AS (SELECT p.sid, p.pos,
                CASE WHEN t1.pos IS NOT NULL THEN p.word || '-' || p.nxt
                     WHEN t2.pos IS NOT NULL THEN NULL ELSE p.word END AS tok
         FROM pos p LEFT JOIN taken t1 ON p.sid = t1.sid AND p.pos = t1.pos
                    LEFT JOIN taken t2 ON p.sid = t2.sid AND p.pos = t2.pos + 1),
per AS (SELECT sid, list(tok ORDER BY pos) FILTER (WHERE tok IS NOT NULL) AS w FROM toks GROUP BY sid)
SELECT s.sid AS item_id, CAST(coalesce(len(p.w), 0) AS BIGINT) AS ntok, coalesce(array_to_string(p.w, ' '), '') AS words
FROM sb s LEFT JOIN per p ON s.sid = p.sid"""

ORACLES["incremental_counts"] = """
WITH s AS (SELECT """ + Q.document_tokens_sql("replace(text, chr(10), ' ')") + """ AS words FROM conversations)
SELECT s.words[t.i] AS w1, s.words[t.i + 1] AS w2, CAST(count(*) AS BIGINT) AS n12
FROM s, unnest(generate_series(1, len(s.words) - 1)) AS t(i) GROUP BY 1, 2"""

ORACLES["tfidf_trimmed"] = BASE + ",\n" + Q.TFIDF_ARTIST + """,
b AS (SELECT genre, artist, CAST(round(quantile_cont(tfidf4, 0.02) * 100, 0) AS BIGINT) AS lo100,
             CAST(round(quantile_cont(tfidf4, 0.98) * 100, 0) AS BIGINT) AS hi100
      FROM tfidf_artist GROUP BY genre, artist)
SELECT t.genre, t.artist, t.word, t.tfidf4 / 10000.0 AS tfidf
FROM tfidf_artist t JOIN b ON t.genre = b.genre AND t.artist = b.artist
WHERE NOT (t.tfidf4 * 100 > b.hi100 OR t.tfidf4 * 100 < b.lo100)"""

ORACLES["artist_vocabulary"] = BASE + """
SELECT DISTINCT genre, artist, word FROM counts"""

ORACLES["random_pick"] = "WITH " + Q.TRACKS + """
SELECT dtag, doc_id FROM tracks ORDER BY md5(dtag || ':42'), dtag LIMIT 1"""

ORACLES["subsample_tokens"] = "WITH " + Q.doc_words_cte() + """,
pos AS (SELECT doc_id, i - 1 AS pos, words[i] AS word FROM dw, unnest(generate_series(1, len(words))) AS t(i)),
f AS (SELECT word, count(*) AS c FROM pos GROUP BY word),
thr AS (SELECT 0.001 * sum(c) AS t FROM f),
p AS (SELECT word, least(1.0, (sqrt(c / (SELECT t FROM thr)) + 1) * (SELECT t FROM thr) / c) AS p FROM f)
SELECT doc_id, CAST(count(*) AS BIGINT) AS ntok,
       CAST(sum(CASE WHEN CAST('0x' || substr(md5(doc_id || ':' || pos || ':42'), 1, 13) AS BIGINT) / 4503599627370496.0 < p.p
                     THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM pos JOIN p ON pos.word = p.word GROUP BY doc_id"""

ORACLES["eval_analogies"] = "WITH " + _U + ",\n" + _AN + """,
best AS (SELECT label, arg_max(vec_id, struct_pack(s := sim, i := -vec_id)) AS got FROM (
  SELECT q.label, u.vec_id, round(""" + _cos("list_transform(list_zip(q.p1, q.p2, q.m1), lambda z: z[1] + z[2] - z[3])", "u.u") + """, 12) AS sim
  FROM qv q CROSS JOIN u WHERE u.vec_id NOT IN (q.a1, q.a2, q.n1)) GROUP BY label),
want AS (SELECT e.label, min(e.vec_id) AS expected FROM e JOIN qv q ON e.label = q.label AND e.vec_id > q.a2 GROUP BY e.label)
SELECT w.label, CAST(count(*) AS BIGINT) AS n_questions, avg(CASE WHEN b.got = w.expected THEN 1.0 ELSE 0.0 END) AS accuracy
FROM want w LEFT JOIN best b ON w.label = b.label GROUP BY w.label"""

ORACLES["coherence_terms"] = BASE + """,
top AS (SELECT word, i // 6 AS topic, i % 6 + 1 AS rank FROM (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS i FROM (
    SELECT t.word, count(*) AS n FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word ORDER BY n DESC, t.word LIMIT 24))),
d AS (SELECT DISTINCT doc_id, word FROM counts WHERE word IN (SELECT word FROM top)),
df AS (SELECT word, count(*) AS n FROM d GROUP BY word),
pr AS (SELECT l.topic, l.word AS wl, m.word AS wm FROM top l JOIN top m ON l.topic = m.topic AND l.rank < m.rank)
SELECT CAST(topic AS BIGINT) AS topic, floor(sum(ln((both_n + 1) / n)) * 1e6 + 0.5) / 1e6 AS coherence FROM (
  SELECT pr.topic, df.n, (SELECT count(*) FROM d a JOIN d b ON a.doc_id = b.doc_id WHERE a.word = pr.wl AND b.word = pr.wm) AS both_n
  FROM pr JOIN df ON df.word = pr.wl) GROUP BY topic"""

ORACLES["phrase_list"] = _PHR + """
SELECT CAST(row_number() OVER (ORDER BY score DESC, phrase) AS BIGINT) AS rank, phrase, floor(score * 1e4 + 0.5) / 10000.0 AS score
FROM phr WHERE score > 10.0"""

ORACLES["vocab_limit"] = "WITH " + Q.doc_words_cte() + """,
wf AS (SELECT t.word, CAST(count(*) AS BIGINT) AS cnt FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word),
r AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC) AS place FROM wf),
m AS (SELECT coalesce((SELECT cnt + 1 FROM r WHERE place = 601), 1) AS least)
SELECT wf.word, wf.cnt, CAST(m.least AS BIGINT) AS min_count FROM wf, m WHERE wf.cnt >= m.least"""

ORACLES["genre_word_diff"] = BASE + """,
top AS (SELECT t.word FROM dw, unnest(dw.words) AS t(word) GROUP BY t.word ORDER BY count(*) DESC, t.word LIMIT 300),
g AS (SELECT genre, min(doc_id) AS topic FROM dw GROUP BY genre),
seen AS (SELECT genre, word, sum(cnt) AS n FROM counts GROUP BY genre, word),
w AS (SELECT g.topic, top.word, coalesce(s.n, 0) + 1 AS weight FROM g CROSS JOIN top LEFT JOIN seen s ON s.genre = g.genre AND s.word = top.word),
p AS (SELECT topic, word, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY topic) AS p,
             row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS r FROM w),
d AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sqrt(greatest(1 - sum(sqrt(a.p * b.p)), 0)) AS h, sum(a.p * ln(a.p / b.p)) AS kl
      FROM p a JOIN p b ON a.word = b.word GROUP BY a.topic, b.topic),
t AS (SELECT topic, word, r FROM p WHERE r <= 50),
x AS (SELECT d.topic_a, d.topic_b, top.word, a.r AS ra, b.r AS rb
      FROM d CROSS JOIN top LEFT JOIN t a ON a.topic = d.topic_a AND a.word = top.word LEFT JOIN t b ON b.topic = d.topic_b AND b.word = top.word),
c AS (SELECT topic_a, topic_b, word, row_number() OVER (PARTITION BY topic_a, topic_b ORDER BY ra + rb, word) AS i FROM x WHERE ra IS NOT NULL AND rb IS NOT NULL),
f AS (SELECT topic_a, topic_b, word, row_number() OVER (PARTITION BY topic_a, topic_b ORDER BY coalesce(ra, rb), word) AS i
      FROM x WHERE (ra IS NULL) <> (rb IS NULL)),
cw AS (SELECT topic_a, topic_b, string_agg(word, ' ' ORDER BY i) AS words FROM c WHERE i <= 10 GROUP BY topic_a, topic_b),
fw AS (SELECT topic_a, topic_b, string_agg(word, ' ' ORDER BY i) AS words FROM f WHERE i <= 10 GROUP BY topic_a, topic_b)
SELECT d.topic_a, d.topic_b, floor(d.h * 1e6 + 0.5) / 1e6 AS hellinger, floor(d.kl * 1e6 + 0.5) / 1e6 AS kullback_leibler,
       coalesce(cw.words, '') AS common, coalesce(fw.words, '') AS different
FROM d LEFT JOIN cw ON cw.topic_a = d.topic_a AND cw.topic_b = d.topic_b LEFT JOIN fw ON fw.topic_a = d.topic_a AND fw.topic_b = d.topic_b"""

ORACLES["find_phrases_turns"] = _PHR + """,
s AS (SELECT """ + Q.document_tokens_sql("text") + """ AS words FROM conversations),
tb AS (SELECT DISTINCT s.words[t.i] AS w1, s.words[t.i + 1] AS w2 FROM s, unnest(generate_series(1, len(s.words) - 1)) AS t(i))
SELECT p.phrase, p.score FROM tb JOIN phr p ON tb.w1 = p.w1 AND tb.w2 = p.w2 WHERE p.score > 10.0"""
