"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; none is capped, sampled or restricted to an id subset.  Output columns
are aliased to the names the SQL oracle uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from .corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --------------------------------------------------------------------------- flagship

@register("artist_top_terms")
def artist_top_terms(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """W2 over A10: the k highest tf-idf words of every artist."""
    c = Corpus.shared(spark, sf_dir)
    top = S.top_terms(c.tfidf_artist, k)
    return top.select("genre", "artist", "rank", "word", S.as_double(F.col("tfidf4")).alias("tfidf"))


# --------------------------------------------------------------------------- text

@register("clean_tokens")
def clean_tokens(spark, sf_dir):
    """T1/T2 on whole tracks: cleaned token count and cleaned text per track."""
    c = Corpus.shared(spark, sf_dir)
    return c.doc_words.select("doc_id", "ntok", F.array_join("words", " ").alias("cleaned"))


@register("track_tags")
def track_tags(spark, sf_dir):
    """Per-artist ordinal and tag of every track."""
    return Corpus.shared(spark, sf_dir).index.select("doc_id", "genre", "artist", "track_no", "dtag")


# --------------------------------------------------------------------------- aggregates

@register("word_freq")
def word_freq(spark, sf_dir, min_count: int = 3):
    """A1/F2: corpus word counts with count >= 3 (main-class default)."""
    return S.word_freq(Corpus.shared(spark, sf_dir).doc_words, min_count)


@register("track_tf")
def track_tf(spark, sf_dir):
    """A3: tf = round(count / distinct words of the track, 4) for every track and word."""
    c = Corpus.shared(spark, sf_dir)
    tf = S.track_tf(c.counts).join(c.index.select("doc_id", "dtag"), "doc_id")
    return tf.select("dtag", "word", "cnt", "uniq", S.as_double(F.col("tf4")).alias("tf"))


@register("idf")
def idf(spark, sf_dir):
    """Document frequency and round(ln(#tracks / df), 4) of every word."""
    c = Corpus.shared(spark, sf_dir)
    return c.idf.select("word", "df", S.as_double(F.col("idf4")).alias("idf"))


@register("tfidf_artist")
def tfidf_artist(spark, sf_dir):
    """A10: per artist and word, mean track tf over registry-covered tracks times idf."""
    c = Corpus.shared(spark, sf_dir)
    return c.tfidf_artist.select("genre", "artist", "word", S.as_double(F.col("mtf4")).alias("mean_tf"),
                                 S.as_double(F.col("tfidf4")).alias("tfidf"))


def _c(spark, sf_dir) -> Corpus:
    return Corpus.shared(spark, sf_dir)


def _joined(col):
    return F.array_join(col, " ")


# --------------------------------------------------------------------------- sources on tables

@register("lines")
def lines(spark, sf_dir):
    """Used lines with cleaned tokens and end-of-track flag."""
    from ..sources import tables as TB
    ln = TB.lines(_c(spark, sf_dir).text_docs)
    return ln.select("doc_id", "line_no", "eot", F.size("tokens").cast("bigint").alias("ntok"),
                     _joined("tokens").alias("cleaned"))


@register("registry")
def registry(spark, sf_dir):
    """Registered tracks with their titles."""
    from ..sources import tables as TB
    c = _c(spark, sf_dir)
    return TB.registry(c.documents, c.labels, c.index).select("genre", "artist", "dtag", "title")


@register("track_by_tag")
def track_by_tag(spark, sf_dir):
    """S3: every track's cleaned lines (in order), with its registry title where it has one."""
    from ..sources import tables as TB
    c = _c(spark, sf_dir)
    return TB.tracks_with_titles(c.text_docs, c.index, TB.registry(c.documents, c.labels, c.index))


@register("titled_tracks")
def titled_tracks(spark, sf_dir):
    """Every track's words with the cleaned title tokens appended (none without a registry title)."""
    from ..sources import tables as TB
    c = _c(spark, sf_dir)
    reg = TB.registry(c.documents, c.labels, c.index).select("doc_id", "title")
    j = c.index.select("doc_id", "dtag").join(c.doc_words.select("doc_id", "words"), "doc_id").join(reg, "doc_id", "left")
    words = F.concat("words", F.coalesce(T.title_tokens("title"), F.array().cast("array<string>")))
    return j.select("dtag", F.size(words).cast("bigint").alias("ntok"), _joined(words).alias("words"))


SELECT_INCLUDE = ["de", "en", "fr"]
SELECT_EXCLUDE_GENRES = ["de"]
SELECT_EXCLUDE_ARTISTS = ["src3", "src7"]


@register("select_corpus")
def select_corpus(spark, sf_dir):
    """Tracks of included genres minus excluded genres and artists."""
    from ..sources import tables as TB
    m = TB.tracks_meta(_c(spark, sf_dir).documents)
    return m.filter(F.col("genre").isin(SELECT_INCLUDE) & ~F.col("genre").isin(SELECT_EXCLUDE_GENRES)
                    & ~F.col("artist").isin(SELECT_EXCLUDE_ARTISTS))


@register("genre_artists")
def genre_artists(spark, sf_dir, requested: list[str] | None = None):
    """S7/SO1: the artists of every genre present (or of the requested ones) with their tracks, one row each."""
    from ..sources import tables as TB
    m = TB.tracks_meta(_c(spark, sf_dir).documents)
    if requested is not None:
        m = m.filter(F.col("genre").isin(requested))
    return m.groupBy("genre", "artist").agg(F.count(F.lit(1)).alias("n_tracks"))


# --------------------------------------------------------------------------- text on tables

@register("clean_string")
def clean_string(spark, sf_dir):
    """A conversation turn cleaned to one space-joined string."""
    cv = _c(spark, sf_dir).table("conversations")
    return cv.select("conv_id", "turn", T.clean_string("text").alias("cleaned"))


@register("normalize_markers")
def normalize_markers(spark, sf_dir):
    """Marker normalisation of every track text (status 13 when no rule applies)."""
    d = _c(spark, sf_dir).text_docs
    txt, status = T.normalize_markers("text")
    return d.select("doc_id", status.cast("bigint").alias("status"),
                    F.length(txt).cast("bigint").alias("n_chars"), F.md5(txt).alias("md5"))


@register("extract_words")
def extract_words(spark, sf_dir):
    """Word extraction of benchmark sentences with the core stop list."""
    from .. import refdata
    b = _c(spark, sf_dir).table("benchmark")
    return b.select("item_id", T.extract_words("text", refdata.CORESTOPS).alias("words"))


@register("double_stops")
def double_stops(spark, sf_dir):
    """Whitespace tokens of conversation turns minus two stop lists (duplicates kept)."""
    cv = _c(spark, sf_dir).table("conversations")
    return cv.select("conv_id", "turn", _joined(T.double_stops(T.split_ws("text"))).alias("cleaned"))


@register("scrub_text")
def scrub_text(spark, sf_dir):
    """ASCII alphabetic tokens (2+ chars, lower case) of conversation turns."""
    cv = _c(spark, sf_dir).table("conversations")
    return cv.select("conv_id", "turn", _joined(T.scrub_text("text")).alias("scrubbed"))


@register("min_len_tokens")
def min_len_tokens(spark, sf_dir):
    """Track tokens longer than three characters (topic-model preparation)."""
    dw = _c(spark, sf_dir).doc_words
    t = T.min_len_tokens(F.col("words"))
    return dw.select("doc_id", F.size(t).cast("bigint").alias("ntok"), _joined(t).alias("words"))


@register("title_tokens")
def title_tokens(spark, sf_dir):
    """Cleaned registry title tokens plus the joined title token."""
    from ..sources import tables as TB
    c = _c(spark, sf_dir)
    reg = TB.registry(c.documents, c.labels, c.index)
    return reg.select("dtag", _joined(T.title_tokens("title", with_joined=True)).alias("title_tokens"))


# --------------------------------------------------------------------------- filters / joins

@register("min_count")
def min_count(spark, sf_dir):
    """words with corpus frequency >= 2 (base-class default)."""
    return S.word_freq_counts(_c(spark, sf_dir).counts, 2)


@register("filter_extremes")
def filter_extremes(spark, sf_dir):
    """words in >= 30 tracks and <= 50% of tracks."""
    from ..operators import filters as FL
    c = _c(spark, sf_dir)
    return FL.filter_extremes(c.counts, c.n_total, 30, 0.5)


@register("tfidf_filter")
def tfidf_filter(spark, sf_dir):
    """tracks after the per-artist 30th-percentile tf-idf filter (empty tracks dropped)."""
    from ..operators import filters as FL
    c = _c(spark, sf_dir)
    out = FL.tfidf_filter(c.doc_words, c.counts, c.idf, c.tfidf_artist)
    out = out.join(c.index.select("doc_id", "dtag"), "doc_id")
    return out.select("dtag", F.size("words").cast("bigint").alias("ntok"), _joined("words").alias("words"))


@register("tfidf_outliers")
def tfidf_outliers(spark, sf_dir):
    """per artist, share of tf-idf values outside the 2nd-98th percentile band."""
    from ..operators import filters as FL
    return FL.tfidf_outliers(_c(spark, sf_dir).tfidf_artist)


@register("extra_training_filter")
def extra_training_filter(spark, sf_dir):
    """per track, words whose artist tf-idf exceeds 0.0299."""
    from ..operators import filters as FL
    c = _c(spark, sf_dir)
    out = FL.extra_training_filter(c.doc_words, c.tfidf_artist, counts=c.counts)
    return out.select("doc_id", F.size("words").cast("bigint").alias("ntok"), _joined("words").alias("words"))


@register("rare_words")
def rare_words(spark, sf_dir):
    """words used by few artists but frequent enough."""
    from ..operators import filters as FL
    c = _c(spark, sf_dir)
    n_art = S.scalar(c.counts.select("genre", "artist").distinct().agg(F.count(F.lit(1))))
    wa = S.word_artists(c.counts)
    return FL.rare_words(wa, S.word_freq_counts(c.counts, 3), n_art).select("word", "n_artists", "cnt")


@register("registry_join")
def registry_join(spark, sf_dir):
    """JN1: tag assignment: the k-th registry tag of the artist, else a synthesized tag."""
    from ..operators.ordinals import group_ordinal
    from ..sources import tables as TB
    c = _c(spark, sf_dir)
    reg = TB.registry(c.documents, c.labels, c.index)
    k = group_ordinal(reg.select("genre", "artist", "track_no"), ["genre", "artist"], "track_no", "k")
    regk = (reg.join(k, ["genre", "artist", "track_no"])
            .select("genre", "artist", F.col("k").alias("track_no"), F.col("dtag").alias("reg_tag"), "title"))
    j = c.index.join(regk, ["genre", "artist", "track_no"], "left")
    return j.select("doc_id", "dtag", F.coalesce("reg_tag", "dtag").alias("assigned_tag"), "title")


# --------------------------------------------------------------------------- aggregates

@register("corpus_counts")
def corpus_counts(spark, sf_dir):
    """A2: tracks, tokens, empty tracks and per-track distinct words per artist."""
    return S.corpus_counts(_c(spark, sf_dir).doc_words)


@register("vocabulary_size")
def vocabulary_size(spark, sf_dir):
    """A2: corpus vocabulary before pruning and raw token total."""
    return S.vocabulary_size(_c(spark, sf_dir).counts)


@register("artist_tf")
def artist_tf(spark, sf_dir):
    """A4: artist tf = word count over the artist / sum of per-track distinct words."""
    c = _c(spark, sf_dir)
    return S.artist_tf(c.counts, c.doc_words).select("genre", "artist", "word", "cnt", "denom", "tf")


@register("word_artists")
def word_artists(spark, sf_dir):
    """A5: number of artists using each word."""
    return S.word_artists(_c(spark, sf_dir).counts)


@register("idf_mean")
def idf_mean(spark, sf_dir):
    """Mean idf over the vocabulary."""
    i = _c(spark, sf_dir).idf
    return i.agg(F.sum("idf4").alias("sum_idf4"), F.count(F.lit(1)).alias("n_words")).select(
        "sum_idf4", "n_words", (F.try_divide(F.col("sum_idf4"), F.col("n_words")) / F.lit(10000.0)).alias("idf_mean"))


@register("tfidf_track")
def tfidf_track(spark, sf_dir):
    """round(track tf x idf, 4) for registry-covered tracks (idf 0 -> mean idf)."""
    c = _c(spark, sf_dir)
    t = S.tfidf_track(c.counts, c.idf, c.covered)
    return t.select("dtag", "word", S.as_double(F.col("tf4")).alias("tf"), S.as_double(F.col("tfidf4")).alias("tfidf"))


@register("tfidf_artist_simple")
def tfidf_artist_simple(spark, sf_dir):
    """round(artist tf x idf, 4) with a zero idf kept."""
    c = _c(spark, sf_dir)
    t = S.tfidf_artist_simple(c.counts, c.doc_words, c.idf)
    return t.select("genre", "artist", "word", S.as_double(F.col("tfidf4")).alias("tfidf"))


@register("bow")
def bow(spark, sf_dir):
    """Artist bag of words over words with frequency >= 2, dense term ids."""
    c = _c(spark, sf_dir)
    return S.bow(c.counts, c.doc_words, 2)


@register("doc_bow")
def doc_bow(spark, sf_dir):
    """Track bag of words over the F3-filtered dictionary (term ids in word order)."""
    from ..operators import filters as FL
    c = _c(spark, sf_dir)
    kept = FL.filter_extremes(c.counts, c.n_total, 30, 0.5)
    vocab = S.dense_vocab(kept.select("word"))
    j = c.counts.join(vocab, "word").join(c.index.select("doc_id", "dtag"), "doc_id")
    return j.select("dtag", "term_id", "word", "cnt")


@register("cloud_weights")
def cloud_weights(spark, sf_dir):
    """Top 120 cloud words (length >= 4, minus the lyric stop list)."""
    from .. import refdata
    return S.cloud_weights(_c(spark, sf_dir).counts, refdata.STOP_LYRICS)


@register("tfidf_histogram")
def tfidf_histogram(spark, sf_dir):
    """Per artist histogram of tf-idf values on [0.0006, median + 3 std]."""
    from .. import refdata
    t = _c(spark, sf_dir).tfidf_artist.withColumn("v", S.as_double(F.col("tfidf4")))
    return S.histogram(t, "v", refdata.TFIDF_HIST_MIN)


@register("tf_histogram")
def tf_histogram(spark, sf_dir):
    """Per artist histogram of artist tf values on [0.002, median + 3 std]."""
    from .. import refdata
    c = _c(spark, sf_dir)
    t = S.artist_tf(c.counts, c.doc_words).withColumn("v", F.col("tf"))
    return S.histogram(t, "v", refdata.TF_HIST_MIN)


@register("compare_histogram")
def compare_histogram(spark, sf_dir):
    """200 equal bins between each artist's min and max tf-idf."""
    t = _c(spark, sf_dir).tfidf_artist.withColumn("v", S.as_double(F.col("tfidf4")))
    return S.minmax_histogram(t, "v")


@register("train_test_split")
def train_test_split(spark, sf_dir, every: int = 5):
    """Corpus-order ordinal of each track; every ``every``-th track is test."""
    from ..operators.evaluate import split
    j = split(_c(spark, sf_dir).index, every)
    return j.select("dtag", F.col("ordinal").cast("bigint").alias("ordinal"), "is_test")


# --------------------------------------------------------------------------- phrases

PHRASE_MIN_COUNT = 10
PHRASE_THRESHOLD = 10.0


def _sentences(spark, sf_dir, table="documents"):
    """Cleaned token arrays of tracks (phrase training) or benchmark items (test sentences)."""
    c = _c(spark, sf_dir)
    if table == "documents":
        return c.doc_words.select(F.col("doc_id").alias("sid"), "words")
    t = c.table("benchmark")
    return t.select(F.col("item_id").alias("sid"), T.document_tokens("text").alias("words"))


def _phrase_model(spark, sf_dir):
    from ..operators import phrases as P
    c = _c(spark, sf_dir)
    return P.score(c.unigrams, c.bigrams, PHRASE_MIN_COUNT, PHRASE_THRESHOLD)


@register("phrase_scores")
def phrase_scores(spark, sf_dir):
    """Scored bigram phrases of the track corpus (delimiter '-')."""
    return _phrase_model(spark, sf_dir)


@register("find_phrases")
def find_phrases(spark, sf_dir):
    """Model phrases found in the benchmark sentences."""
    from ..operators import phrases as P
    return P.find_phrases(_sentences(spark, sf_dir, "benchmark"), _phrase_model(spark, sf_dir))


@register("find_phrases_turns")
def find_phrases_turns(spark, sf_dir):
    """P2 on many sentences: model phrases found in the conversations' turns."""
    from ..operators import phrases as P
    turns = _c(spark, sf_dir).table("conversations").select(T.document_tokens("text").alias("words"))
    return P.find_phrases(turns, _phrase_model(spark, sf_dir))


@register("apply_phrases")
def apply_phrases(spark, sf_dir):
    """Benchmark sentences rewritten with detected phrases joined by '-'."""
    from ..operators import phrases as P
    out = P.apply_phrases(_sentences(spark, sf_dir, "benchmark"), _phrase_model(spark, sf_dir), "sid")
    return out.select(F.col("sid").alias("item_id"), F.size("words").cast("bigint").alias("ntok"),
                      _joined("words").alias("words"))


@register("merge_phrase_counts")
def merge_phrase_counts(spark, sf_dir):
    """Phrase model after adding the benchmark sentences' counts to the corpus counts."""
    from ..operators import phrases as P
    c, b = _c(spark, sf_dir), _sentences(spark, sf_dir, "benchmark")
    uni = P.merge_counts(c.unigrams, P.unigram_counts(b), ["word"])
    bi = P.merge_counts(c.bigrams, P.bigram_counts(b), ["w1", "w2"])
    return P.score(uni, bi, PHRASE_MIN_COUNT, PHRASE_THRESHOLD)


@register("phrase_stats")
def phrase_stats(spark, sf_dir):
    """Summary statistics of the phrase scores."""
    from ..operators import phrases as P
    return P.phrase_stats(_phrase_model(spark, sf_dir))


@register("phrase_list")
def phrase_list(spark, sf_dir):
    """The phrases in order of their scores."""
    from ..operators import phrases as P
    return P.phrase_list(_phrase_model(spark, sf_dir)).select("rank", "phrase", S.as_double(F.floor(F.col("score") * 1e4 + 0.5)).alias("score"))


# --------------------------------------------------------------------------- vectors (embeddings table)

def _emb(spark, sf_dir):
    return _c(spark, sf_dir).table("embeddings")


@register("normed_vector")
def normed_vector(spark, sf_dir):
    """Dimension and length of every vector (unit vectors are ``vectors.unit``)."""
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), V.r6(V.norm(F.col("embedding"))).alias("norm"))


def _centroids(e):
    from ..operators import vectors as V
    return V.group_mean(e.select("label", V.unit(F.col("embedding")).alias("u")), "label", "u")


@register("most_similar_vec")
def most_similar_vec(spark, sf_dir):
    """The 10 vectors most similar to each label centroid (similar_by_vector)."""
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    t = V.top_k_similar(e, "vec_id", "embedding", _centroids(e), "label", "u", 10)
    return t.select("label", "rank", "vec_id", V.r6(F.col("sim")).alias("sim"))


def _analogy_inputs(e):
    """Per label L: positives = two smallest ids of L, negative = smallest id of the next label."""
    a1 = e.groupBy("label").agg(F.min("vec_id").alias("a1"))
    a2 = (e.join(a1, "label").filter(F.col("vec_id") > F.col("a1"))
          .groupBy("label").agg(F.min("vec_id").alias("a2")))
    from pyspark.sql import Window as W
    nxt = a1.withColumn("nl", F.coalesce(F.lead("label").over(W.orderBy("label")),
                                         F.min("label").over(W.partitionBy())))
    neg = nxt.select("label", "nl").join(a1.select(F.col("label").alias("nl"), F.col("a1").alias("n1")), "nl")
    q = a1.join(a2, "label").join(neg.select("label", "n1"), "label")
    return q.select("label", F.array("a1", "a2").alias("pos"), F.array("n1").alias("neg"))


def _analogy_vectors(e, inputs):
    from ..operators import vectors as V
    u = e.select("vec_id", V.unit(F.col("embedding")).alias("u"))
    terms = (inputs.select("label", F.explode("pos").alias("vec_id")).withColumn("w", F.lit(1.0))
             .unionByName(inputs.select("label", F.explode("neg").alias("vec_id")).withColumn("w", F.lit(-1.0))))
    lng = terms.join(u, "vec_id").select("label", "w", F.posexplode("u").alias("dim", "x"))
    per = lng.groupBy("label", "dim").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    vec = (per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_v"))
           .select("label", F.transform("_v", lambda s: s["x"]).alias("q")))
    excl = (inputs.select("label", F.explode(F.concat("pos", "neg")).alias("vec_id")))
    return vec, excl


@register("analogy")
def analogy(spark, sf_dir):
    """most_similar(positive, negative): top 10 by cosine to the signed mean of unit vectors."""
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    vec, excl = _analogy_vectors(e, _analogy_inputs(e))
    t = V.top_k_similar(e, "vec_id", "embedding", vec, "label", "q", 10, exclude=excl)
    return t.select("label", "rank", "vec_id", V.r6(F.col("sim")).alias("sim"))


@register("analogy_cosmul")
def analogy_cosmul(spark, sf_dir):
    """most_similar_cosmul (3CosMul) for the same analogy questions."""
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    inp = _analogy_inputs(e)
    emb_by_id = e.select("vec_id", "embedding")
    def vecs(col):
        x = inp.select("label", F.posexplode(col).alias("i", "vec_id")).join(emb_by_id, "vec_id")
        return x.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "embedding"))).alias("_v")) \
            .select("label", F.transform("_v", lambda s: s["embedding"]).alias(col))
    q = vecs("pos").join(vecs("neg"), "label")
    excl = inp.select("label", F.explode(F.concat("pos", "neg")).alias("vec_id"))
    t = V.top_k_similar(e, "vec_id", "embedding", q, "label", "pos", 10, exclude=excl, mode="cosmul", neg="neg")
    return t.select("label", "rank", "vec_id", V.r6(F.col("sim")).alias("score"))


@register("odd_one_out")
def odd_one_out(spark, sf_dir):
    """doesnt_match per label: the member least similar to the label's mean unit vector."""
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    cen = _centroids(e)
    j = e.join(cen, "label").select("label", "vec_id", V.cosine(F.col("embedding"), F.col("u")).alias("sim"))
    best = j.groupBy("label").agg(F.min(F.struct("sim", "vec_id")).alias("m"))
    return best.select("label", F.col("m.vec_id").alias("vec_id"), V.r6(F.col("m.sim")).alias("sim"))


def _pairs(e):
    from ..operators import vectors as V
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), F.col("label").alias("la"))
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), F.col("label").alias("lb"))
    j = a.join(b, F.col("b") == F.col("a") + 1)
    return j.select("a", "b", V.cosine(F.col("ea"), F.col("eb")).alias("sim"),
                    F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0).alias("human"))


@register("pair_similarity")
def pair_similarity(spark, sf_dir):
    """similarity(a, b) for every pair of consecutive ids."""
    from ..operators import vectors as V
    return _pairs(_emb(spark, sf_dir)).select("a", "b", V.r6(F.col("sim")).alias("sim"))


@register("set_similarity")
def set_similarity(spark, sf_dir):
    """n_similarity(even ids, odd ids) of each label."""
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    u = e.select("label", (F.col("vec_id") % 2).alias("half"), V.unit(F.col("embedding")).alias("u"))
    g = u.select(F.concat_ws(":", "label", "half").alias("g"), "label", "half", "u")
    m = V.group_mean(g.select("g", "u"), "g", "u")
    m = m.join(g.select("g", "label", "half").distinct(), "g")
    a = m.filter(F.col("half") == 0).select("label", F.col("u").alias("ua"))
    b = m.filter(F.col("half") == 1).select("label", F.col("u").alias("ub"))
    return a.join(b, "label").select("label", V.r6(V.cosine(F.col("ua"), F.col("ub"))).alias("sim"))


@register("eval_word_pairs")
def eval_word_pairs(spark, sf_dir):
    """Pearson and Spearman (average ranks) correlation of pair similarity with a
    same-label score."""
    from ..operators import vectors as V
    from ..operators.evaluate import correlations
    p = _pairs(_emb(spark, sf_dir)).withColumn("sim6", V.r6(F.col("sim")))
    # ranks on the 6-digit similarity so ties are the same in every engine
    c = correlations(p, "sim6", "human").select("n", V.r6(F.col("spearman")).alias("spearman"))
    pear = p.agg(F.count(F.lit(1)).alias("n_pairs"), V.r6(F.corr("sim", "human")).alias("pearson"))
    return pear.select("n_pairs", "pearson", c.select("spearman").scalar().alias("spearman"))


@register("vocab_lookup")
def vocab_lookup(spark, sf_dir):
    """For every benchmark word: is it in the corpus vocabulary and how often."""
    c = _c(spark, sf_dir)
    words = S.explode_words(_sentences(spark, sf_dir, "benchmark")).select("word").distinct()
    wf = S.word_freq_counts(c.counts, 1)
    return (words.join(wf, "word", "left")
            .select("word", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"),
                    F.col("cnt").isNotNull().alias("in_vocab")))


@register("similar_docs")
def similar_docs(spark, sf_dir, k: int = 10):
    """E5: top-10 tracks per benchmark sentence by exact sparse tf-idf cosine."""
    from ..operators import similarity as SIM
    c = _c(spark, sf_dir)
    q = _sentences(spark, sf_dir, "benchmark").withColumn("uniq", F.size(F.array_distinct("words")).cast("bigint"))
    qc = S.explode_words(q, "sid", "uniq").groupBy("sid", "uniq", "word").agg(F.count(F.lit(1)).alias("cnt"))
    out = SIM.sparse_top_k(qc, "sid", c.counts, "doc_id", c.idf, k)
    return out.select(F.col("sid").alias("item_id"), "rank", "doc_id", "sim")


# --------------------------------------------------------------------------- ML models (rows-only checks)

W2V = dict(dim=64, window=5, min_count=5, epochs=5, seed=42)


def _w2v(spark, sf_dir):
    from ..operators import models as M
    c = _c(spark, sf_dir)
    key = ("w2v", sf_dir)
    cache = getattr(c, "_models", None)
    if cache is None:
        cache = c._models = {}
    if key not in cache:
        cache[key] = M.fit_word2vec(c.doc_words, **W2V)
    return cache[key]


@register("word2vec")
def word2vec(spark, sf_dir):
    """Skip-gram word vectors of the track corpus (word, dim, norm)."""
    from ..operators import models as M
    from ..operators import vectors as V
    wv = M.word_vectors(_w2v(spark, sf_dir))
    return wv.select("word", F.size("v").cast("bigint").alias("dim"), V.r6(V.norm(F.col("v"))).alias("norm"))


@register("subsample_tokens")
def subsample_tokens(spark, sf_dir):
    """Tokens kept per track by frequent-word subsampling (sample = 1e-3)."""
    from ..operators import models as M
    c = _c(spark, sf_dir)
    k = M.subsample_keep(c.doc_words, S.word_freq(c.doc_words, 1))
    return k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ntok"),
                                   F.sum(F.col("keep").cast("int")).cast("bigint").alias("kept"))


def _doc_weights(c):
    """(doc_id, word, w): integer tf-idf weights of every track's terms."""
    from ..operators.similarity import weights
    return weights(c.counts, "doc_id", c.idf)


@register("doc_vectors")
def doc_vectors(spark, sf_dir):
    """Tf-idf weighted mean word vector of every track."""
    from ..operators import models as M
    from ..operators import vectors as V
    c = _c(spark, sf_dir)
    dv = M.weighted_doc_vectors(_doc_weights(c), "doc_id", M.word_vectors(_w2v(spark, sf_dir)))
    return dv.select("doc_id", F.size("v").cast("bigint").alias("dim"), V.r6(V.norm(F.col("v"))).alias("norm"))


DBOW_MIN_COUNT = 2


def _dbow(spark, sf_dir, docs, key):
    """Paragraph vectors of documents against the corpus' word vectors, words met once left out."""
    from ..operators import docvec as DV
    from ..operators import models as M
    c = _c(spark, sf_dir)
    words = M.word_vectors(_w2v(spark, sf_dir)).join(S.word_freq_counts(c.counts, DBOW_MIN_COUNT), "word")
    return DV.dbow_vectors(docs.select(key, "words"), key, "words", words, DV.Settings(dim=W2V["dim"]))


def _dbow_tracks(spark, sf_dir):
    """Paragraph vectors of all tracks, written once for a session's corpus."""
    from ..session import keep_table
    c = _c(spark, sf_dir)
    _w2v(spark, sf_dir)
    if "dbow" not in c._models:
        c._models["dbow"] = keep_table(_dbow(spark, sf_dir, c.doc_words, "doc_id"), "dbow")
    return c._models["dbow"]


@register("doc_vectors_dbow")
def doc_vectors_dbow(spark, sf_dir):
    """E3, second mode: paragraph vector (distributed bag of words) of every track."""
    from ..operators import vectors as V
    return _dbow_tracks(spark, sf_dir).select("doc_id", F.size("v").cast("bigint").alias("dim"), V.r6(V.norm(F.col("v"))).alias("norm"))


@register("infer_doc_dbow")
def infer_doc_dbow(spark, sf_dir):
    """E4, second mode: paragraph vectors of unseen benchmark sentences."""
    from ..operators import vectors as V
    v = _dbow(spark, sf_dir, _sentences(spark, sf_dir, "benchmark"), "sid")
    return v.select(F.col("sid").alias("item_id"), F.size("v").cast("bigint").alias("dim"), V.r6(V.norm(F.col("v"))).alias("norm"))


@register("similar_docs_dense")
def similar_docs_dense(spark, sf_dir, k: int = 10):
    """E5, dense: the 10 tracks nearest to each benchmark sentence by paragraph vectors, through the hashed index."""
    from ..operators import dense_index as DI
    from ..operators import vectors as V
    tracks = _dbow_tracks(spark, sf_dir)
    planes = DI.fit(tracks, "doc_id", "v")
    index = DI.build(tracks, "doc_id", "v", planes, k)
    out = DI.search(index, planes, _dbow(spark, sf_dir, _sentences(spark, sf_dir, "benchmark"), "sid"), "sid", "v", k, key="doc_id")
    return out.select(F.col("sid").alias("item_id"), "rank", "doc_id", V.r6(F.col("sim")).alias("sim"))


@register("similar_vec_index")
def similar_vec_index(spark, sf_dir, k: int = 10):
    """E5/E6 through the hashed index: the 10 vectors nearest to each one whose id is divisible by 50."""
    from ..operators import dense_index as DI
    from ..operators import vectors as V
    e = _emb(spark, sf_dir)
    planes = DI.fit(e, "vec_id", "embedding")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = DI.search(DI.build(e, "vec_id", "embedding", planes, k), planes, q, "query_id", "embedding", k, key="vec_id", exclude_same=True)
    return out.select("query_id", "rank", "vec_id", V.r6(F.col("sim")).alias("sim"))


@register("vocab_limit")
def vocab_limit(spark, sf_dir, limit: int = 600):
    """The words that a vocabulary limit of 600 leaves (the original's default), and the least count it asks for."""
    from ..operators import models as M
    return M.limit_vocabulary(S.word_freq_counts(_c(spark, sf_dir).counts, 1), limit)


def _query_vectors(spark, sf_dir):
    from ..operators import models as M
    c = _c(spark, sf_dir)
    q = _sentences(spark, sf_dir, "benchmark").withColumn("uniq", F.size(F.array_distinct("words")).cast("bigint"))
    qc = S.explode_words(q, "sid", "uniq").groupBy("sid", "uniq", "word").agg(F.count(F.lit(1)).alias("cnt"))
    from ..operators.similarity import weights
    return M.weighted_doc_vectors(weights(qc, "sid", c.idf), "sid", M.word_vectors(_w2v(spark, sf_dir)))


@register("infer_doc")
def infer_doc(spark, sf_dir):
    """Vectors of unseen benchmark sentences with the trained word vectors."""
    from ..operators import vectors as V
    qv = _query_vectors(spark, sf_dir)
    return qv.select(F.col("sid").alias("item_id"), F.size("v").cast("bigint").alias("dim"),
                     V.r6(V.norm(F.col("v"))).alias("norm"))


@register("predict_center")
def predict_center(spark, sf_dir):
    """The 10 vocabulary words nearest to each benchmark sentence's mean vector."""
    from ..operators import models as M
    from ..operators import vectors as V
    wv = M.word_vectors(_w2v(spark, sf_dir))
    qv = _query_vectors(spark, sf_dir)
    t = V.top_k_similar(wv, "word", "v", qv, "sid", "v", 10)
    return t.select(F.col("sid").alias("item_id"), "rank", "word", V.r6(F.col("sim")).alias("sim"))


@register("pca_2d")
def pca_2d(spark, sf_dir):
    """2-D principal-component projection of the embedding vectors."""
    from ..operators import models as M
    return M.pca_2d(_emb(spark, sf_dir), "vec_id", "embedding")


@register("kmeans")
def kmeans(spark, sf_dir):
    """K-means (k = 10) cluster of every embedding vector."""
    from ..operators import models as M
    return M.kmeans(_emb(spark, sf_dir), "vec_id", "embedding", 10)


@register("eval_analogies")
def eval_analogies(spark, sf_dir):
    """Accuracy per section (label): is the top answer of the label's question the expected
    one, the third smallest id of the label."""
    from ..operators.evaluate import analogy_accuracy
    e = _emb(spark, sf_dir)
    inp = _analogy_inputs(e).select("label", F.col("pos")[1].alias("a2"))
    expected = (e.join(inp, "label").filter(F.col("vec_id") > F.col("a2"))
                .groupBy("label").agg(F.min("vec_id").alias("expected")))
    return analogy_accuracy(analogy(spark, sf_dir), expected, "label", "vec_id")


# --------------------------------------------------------------------------- topics

LDA_K = 20
LDA_MIN_DF = 30


def _lda_docs(c):
    return c.doc_words.select("doc_id", T.min_len_tokens(F.col("words")).alias("words"))


def _lda(spark, sf_dir, seed=7):
    from ..operators import topics as TP
    c = _c(spark, sf_dir)
    cache = getattr(c, "_models", None)
    if cache is None:
        cache = c._models = {}
    key = ("lda", seed)
    if key not in cache:
        docs = _lda_docs(c)
        if "cv" not in cache:
            cache["cv"] = TP.fit_dictionary(docs, LDA_MIN_DF, 0.5)
            # every iteration of the fit reads all bags again: they are taken from the tokens once
            cache["bow"] = c._keep(cache["cv"].transform(docs).select("doc_id", "bow"), "lda_bow")
        cv, bow = cache["cv"], cache["bow"]
        cache[key] = (cv, TP.fit_lda(bow, LDA_K, passes=4, seed=seed), bow)
    return cache[key]


@register("lda_fit")
def lda_fit(spark, sf_dir):
    """Fitted online LDA summary: log likelihood and log perplexity over the whole corpus."""
    from ..operators import topics as TP
    cv, m, bow = _lda(spark, sf_dir)
    return spark.createDataFrame([(LDA_K, len(cv.vocabulary), *TP.likelihood(m, bow))],
                                 "k int, vocab int, log_likelihood double, log_perplexity double")


@register("topic_terms")
def topic_terms(spark, sf_dir):
    """L2: the 8 heaviest words of every topic."""
    from ..operators import topics as TP
    cv, m, _ = _lda(spark, sf_dir)
    return TP.topic_terms(m, TP.vocab_table(spark, cv), 8)


@register("topic_terms_wide")
def topic_terms_wide(spark, sf_dir):
    """L2: the topic table, one row per topic and one column per rank."""
    from ..operators import topics as TP
    return TP.topic_terms_wide(topic_terms(spark, sf_dir))


@register("topic_mixture")
def topic_mixture(spark, sf_dir):
    """L3: (track, topic, weight) for every topic a track holds with at least one hundredth."""
    from ..operators import topics as TP
    _, m, bow = _lda(spark, sf_dir)
    return TP.topic_mixture(m, bow, "doc_id")


@register("coherence_terms")
def coherence_terms(spark, sf_dir, lists: int = 4, n: int = 6):
    """L6 on stated term lists: UMass coherence of the most frequent words, ``n`` to a list."""
    from pyspark.sql import Window as W
    from ..operators import topics as TP
    from ..operators.vectors import r6
    c = _c(spark, sf_dir)
    top = S.word_freq_counts(c.counts, 1).orderBy(F.col("cnt").desc(), F.col("word")).limit(lists * n)
    at = F.row_number().over(W.orderBy(F.col("cnt").desc(), F.col("word"))) - 1  # lists * n rows
    top = top.select("word", at.alias("i")).select(F.floor(F.col("i") / n).alias("topic"), (F.col("i") % n + 1).cast("bigint").alias("rank"), "word")
    return TP.umass_coherence(top, c.counts).select("topic", r6(F.col("coherence")).alias("coherence"))


@register("artist_vocabulary")
def artist_vocabulary(spark, sf_dir):
    """A5: the words of every artist (genre, artist, word)."""
    return S.artist_words(_c(spark, sf_dir).counts)


@register("doc_topics")
def doc_topics(spark, sf_dir):
    """L3: dominant topic of every track."""
    from ..operators import topics as TP
    _, m, bow = _lda(spark, sf_dir)
    return TP.doc_topics(m, bow, "doc_id")


@register("infer_topics")
def infer_topics(spark, sf_dir):
    """Dominant topic of unseen benchmark sentences through the fitted dictionary."""
    from ..operators import topics as TP
    cv, m, _ = _lda(spark, sf_dir)
    q = _sentences(spark, sf_dir, "benchmark").select("sid", T.min_len_tokens(F.col("words")).alias("words"))
    return TP.doc_topics(m, cv.transform(q), "sid").withColumnRenamed("sid", "item_id")


@register("topic_diff")
def topic_diff(spark, sf_dir):
    """Differences between the topics of two differently seeded models, with common and different terms."""
    from ..operators import topics as TP
    cv, m1, _ = _lda(spark, sf_dir, 7)
    _, m2, _ = _lda(spark, sf_dir, 11)
    return TP.topic_diff(m1, m2, TP.vocab_table(spark, cv))


@register("genre_word_diff")
def genre_word_diff(spark, sf_dir, vocabulary: int = 300):
    """L5 on stated topics: a genre's shares of the 300 most frequent words (each counted once more) are its topic."""
    from ..operators import topics as TP
    from ..operators.vectors import r6
    c = _c(spark, sf_dir)
    top = S.word_freq_counts(c.counts, 1).orderBy(F.col("cnt").desc(), F.col("word")).limit(vocabulary).select("word")
    genres = c.doc_words.groupBy("genre").agg(F.min("doc_id").alias("topic"))  # its first track numbers a genre
    seen = c.counts.join(top, "word", "left_semi").groupBy("genre", "word").agg(F.sum("cnt").alias("n"))
    every = genres.select("genre", "topic", F.explode(S.scalar(top.agg(F.collect_list("word")))).alias("word"))
    t = every.join(seen, ["genre", "word"], "left").select("topic", "word", (F.coalesce("n", F.lit(0)) + 1).cast("double").alias("weight"))
    d = TP.compare_topics(t, t, 50, 10)
    return d.select("topic_a", "topic_b", r6(F.col("hellinger")).alias("hellinger"), r6(F.col("kullback_leibler")).alias("kullback_leibler"),
                    F.array_join("common", " ").alias("common"), F.array_join("different", " ").alias("different"))


@register("word_topics")
def word_topics(spark, sf_dir):
    """L1/L3: the topics of every word of every track, with at least one hundredth of the word."""
    from ..operators import topics as TP
    cv, m, _ = _lda(spark, sf_dir)
    return TP.word_topics(m, cv.transform(_lda_docs(_c(spark, sf_dir))), "doc_id", TP.vocab_table(spark, cv))


@register("topic_coherence")
def topic_coherence(spark, sf_dir):
    """UMass coherence of every topic's 6 top words over the track corpus."""
    from ..operators import topics as TP
    cv, m, _ = _lda(spark, sf_dir)
    top = TP.topic_terms(m, TP.vocab_table(spark, cv), 6)
    return TP.umass_coherence(top, _c(spark, sf_dir).counts)


@register("topic_weights")
def topic_weights(spark, sf_dir):
    """Full topic-term weight table (topic, term_id, weight), normalised per topic."""
    cv, m, _ = _lda(spark, sf_dir)
    d = m.describeTopics(len(cv.vocabulary))
    z = d.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "t"))
    return z.select(F.col("topic").cast("bigint").alias("topic"), F.col("t.termIndices").cast("bigint").alias("term_id"),
                    F.col("t.termWeights").alias("weight"))


@register("cooccurrence")
def cooccurrence(spark, sf_dir, n: int = 20):
    """Tracks containing both words, for every pair of the 20 most frequent words."""
    from ..operators import topics as TP
    c = _c(spark, sf_dir)
    top = S.word_freq_counts(c.counts, 1).orderBy(F.col("cnt").desc(), F.col("word")).limit(n)
    return TP.cooccurrence(c.counts, top)


# --------------------------------------------------------------------------- payload gate on pages

@register("ingest_gate")
def ingest_gate(spark, sf_dir):
    """Pages whose url ends with 'html' and whose text exceeds 80 characters, with the
    url-sliced title and per-site ordinals that count kept pages only."""
    from ..sources import payloads as PL
    pg = _c(spark, sf_dir).table("pages").select(
        F.regexp_extract("url", "://([^/]+)", 1).alias("site"), "page_id", "url", F.col("html").alias("text"))
    g = PL.ingest_gate(pg, suffix="html", key="site", order="page_id")
    return g.select("site", "page_id", "track_no", "dtag", "title")


# --------------------------------------------------------------------------- sampling / continued training

@register("random_pick")
def random_pick(spark, sf_dir, seed: int = 42):
    """One pseudo-random track (seeded hash order; the pick is the feature, so a limit)."""
    idx = _c(spark, sf_dir).index
    return (idx.withColumn("h", F.md5(F.concat_ws(":", "dtag", F.lit(seed))))
            .orderBy("h", "dtag").limit(1).select("dtag", "doc_id"))


@register("continued_training")
def continued_training(spark, sf_dir):
    """SO2: word vectors refit on the track corpus united with the benchmark sentences
    (MLlib has no warm start; the union is refit)."""
    from ..operators import models as M
    from ..operators import vectors as V
    c = _c(spark, sf_dir)
    both = c.doc_words.select("words").unionByName(_sentences(spark, sf_dir, "benchmark").select("words"))
    wv = M.word_vectors(M.fit_word2vec(both, **W2V))
    return wv.select("word", V.r6(V.norm(F.col("v"))).alias("norm"))


# --------------------------------------------------------------------------- streaming

@register("incremental_counts")
def incremental_counts(spark, sf_dir, n_files: int = 4):
    """ST1: conversation turns landed as text files (written by Spark into the session's shared
    folder), streamed in micro-batches into per-batch partial counts, and merged: the bigram counts
    of the grown corpus."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming import incremental as ST
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/incremental-" + uuid.uuid4().hex
    cv = _c(spark, sf_dir).table("conversations")
    (cv.select((F.col("conv_id") % n_files).alias("part"), F.col("text"))
     .withColumn("text", F.regexp_replace("text", "\n", " "))
     .write.partitionBy("part").text(base + "/in"))
    q = ST.start_incremental_counts(spark, base + "/in/*", base + "/out", base + "/ck")
    ST.run_to_completion(q)
    _, bi = ST.merged_counts(spark, base + "/out")
    return bi.select("w1", "w2", F.col("n12").cast("bigint").alias("n12"))


@register("relaxed_wmd")
def relaxed_wmd(spark, sf_dir):
    """Relaxed word mover's distance between consecutive benchmark sentences
    (item i vs item i + 1) with the trained word vectors."""
    from ..operators import models as M
    from ..operators import vectors as V
    s = _sentences(spark, sf_dir, "benchmark")
    bag = (S.explode_words(s, "sid").groupBy("sid", "word").agg(F.count(F.lit(1)).alias("c")))
    side_a = bag.select(F.col("sid").alias("pair"), F.lit(0).alias("side"), "word", F.col("c").cast("double").alias("w"))
    side_b = bag.select((F.col("sid") - 1).alias("pair"), F.lit(1).alias("side"), "word", F.col("c").cast("double").alias("w"))
    ids = s.select(F.col("sid").alias("pair"))
    pairs = side_a.unionByName(side_b).join(ids, "pair", "left_semi") \
        .join(ids.select((F.col("pair") - 1).alias("pair")), "pair", "left_semi")
    out = V.relaxed_wmd(pairs, "pair", "side", M.word_vectors(_w2v(spark, sf_dir)))
    return out.select(F.col("pair").alias("item_a"), (F.col("pair") + 1).alias("item_b"),
                      V.r6(F.col("rwmd")).alias("rwmd"))


@register("tfidf_trimmed")
def tfidf_trimmed(spark, sf_dir):
    """the artist tf-idf table after removing each artist's values above the 98th or
    below the 2nd percentile."""
    from ..operators import filters as FL
    t = FL.drop_outliers(_c(spark, sf_dir).tfidf_artist)
    return t.select("genre", "artist", "word", S.as_double(F.col("tfidf4")).alias("tfidf"))
