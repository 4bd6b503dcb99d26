"""Reference data used by the text functions.

Everything below the FIXED VALUES marker must equal the values of the
original toolkit, otherwise cleaned tokens, tf and idf differ.  They are
stated as plain text in their original order; nothing is derived from them
except the small helper views at the end of the file.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original toolkit's values for identical results)
# ---------------------------------------------------------------------------

# Genre vocabulary accepted by the genre validity check.
GENRES = ["rap", "rock", "firstwave", "alternative", "metal", "punk", "country", "pop", "folkrock"]

# Track marker line written between tracks of one corpus file.
TRACK_MARKER = "SONGBREAK"
# Marker text produced by the lyrics site at the end of a page (normalised to TRACK_MARKER).
EMBED_MARKER = "EmbedShare URLCopyEmbedCopy"

# Character conversion applied after lower-casing (source char -> replacement; '' deletes).
CHAR_CONVERSION = [
    ("​", ""),
    (" ", " "),
    (" ", " "),
    (" ", " "),
    (" ", " "),
    (" ", " "),
    ("‐", "-"),
    ("‑", "-"),
    ("‒", "-"),
    ("–", "-"),
    ("—", "-"),
    ("―", "-"),
    ("‘", "'"),
    ("’", "'"),
    ("‚", "'"),
    ("‛", "'"),
    ("“", "'"),
    ("”", "'"),
    ("„", "'"),
    ("‟", "'"),
    ("…", "'"),
    ("－", "-"),
    ("ö", "o"),
    ("ü", "u"),
]

# Quote / dash conversion applied after CHAR_CONVERSION (source chars, target chars).
QUOTEDASH_FROM = "‘’´“”–－᠆–-"
QUOTEDASH_TO = "'''''-----"

# Punctuation deleted from a cleaned line.
PUNCTUATION = "[];:,.?!*$&@%<>'(){}"

# Core stop words dropped by the line cleaner.
CORESTOPS = [
    "a", "about", "also", "am", "among", "an", "and", "any", "are", "as",
    "at", "be", "because", "but", "by", "can", "cause", "could", "do",
    "either", "else", "ever", "for", "from", "got", "ha", "have", "his",
    "hers", "how", "however", "if", "is", "it", "just", "let",
    "like", "likely", "may", "me", "might", "must", "of", "off",
    "often", "oh", "on", "or", "should", "so", "some", "than", "that",
    "the", "their", "then", "there", "these", "they", "this", "tis",
    "to", "too", "twas", "us", "was", "way", "what",
    "which", "while", "whom", "will", "with", "would", "yall", "yet",
]

# First stop list of the two-list stop filter.
GS_STOP = [
    "RT", "a", "about", "all", "almost", "also", "among", "am", "an", "and", "already",
    "any", "are", "as", "at", "back", "because", "but", "by", "came", "cause", "come",
    "could", "day", "did", "dont", "does", "earlier", "either", "else", "ever", "even",
    "for", "follow", "from", "go", "going", "got", "has", "had", "have", "his", "her",
    "hers", "how", "not", "however", "if", "I", "in", "into", "is", "it", "its",
    "just", "least", "who", "let", "lets", "like", "likely", "may", "me",
    "might", "must", "much", "my", "need", "no", "now", "of", "often", "on",
    "one", "only", "or", "other", "our", "past",
    "own", "part", "rather", "really", "same", "seems", "sent", "shall", "show",
    "should", "since", "so", "some", "something", "still", "such", "than", "that",
    "thats", "the", "their", "them", "then", "there", "these", "they", "think",
    "this", "those", "thus", "to", "too", "two", "used", "was", "watch", "well",
    "were", "what", "while", "who", "will", "would", "whom",
    "with", "yet", "your", "rt", "we", "what", "been", "more", "when",
    "big", "after", "he", "man", "us", "off", "les", "des", "et",
    "il", "en", "before", "di", "us", "very", "you",
]

# Second stop list of the two-list stop filter.
STOP_LYRICS = [
    "aint", "am", "are", "back", "came", "can", "cannot", "cant", "come", "dont",
    "everything", "get", "getting", "go", "going", "gonna", "got", "gotta", "has", "he",
    "her", "him", "i", "id", "ill", "im", "is", "isnt", "ive", "keep", "know",
    "la", "let", "made", "maybe", "need", "never", "now", "not", "oh",
    "ooh", "one", "really", "said", "say", "see", "she", "shes", "still",
    "sure", "take", "tell", "thats", "theres", "they", "theyre", "thing", "think",
    "time", "told", "two", "walk", "whats", "was", "way", "we", "want", "well",
    "went", "were", "whatll", "will", "wont", "word", "would", "you",
    "make", "nothing", "give", "hear", "right", "night", "day", "little", "sometimes",
]

# Ad-hoc words added to a stop file when it is read.
ADHOC_STOPS = [
    "ha", "oh", "get", "got", "one", "say", "like", "la", "go", "say",
    "said", "yeah", "ya", "u", "da", "give", "thing", "way", "really",
    "let", "whoa", "hey", "na", "put", "doo", "doo", "let", "fa", "cata",
    "hi", "so", "little", "dit", "songbreak", "could",
]

# Contraction expansions, applied in this order as literal substring replacements.
CONTRACTIONS = [
    ("ain't", "aint"),
    ("aren't", "are not"),
    ("arent", "are not"),
    ("can't", "can not"),
    ("cant", "can not"),
    ("'cause", "because"),
    ("citys", "city is"),
    ("could've", "could have"),
    ("couldn't", "could not"),
    ("didn't", "did not"),
    ("doesn't", "does not"),
    ("don't", "do not"),
    ("dont", "do not"),
    ("'em", "them"),
    ("everything's", "everything is"),
    ("hadn't", "had not"),
    ("hasn't", "has not"),
    ("haven't", "have not"),
    ("he'd", "he would"),
    ("he'll", "he will"),
    ("he's", "he is"),
    ("how'd", "how did"),
    ("how'll", "how will"),
    ("how's", "how is"),
    ("i'd", "i would"),
    ("i'll", "i will"),
    ("i'm", "i am"),
    ("i've", "i have"),
    ("isn't", "is not"),
    ("isnt", "is not"),
    ("it'd", "it would"),
    ("it'll", "it will"),
    ("it'll've", "it will have"),
    ("its", "it is"),
    ("it's", "it is"),
    ("let's", "let us"),
    ("ma'am", "mam"),
    ("mayn't", "may not"),
    ("might've", "might have"),
    ("mightn't", "might not"),
    ("mo'", "more"),
    ("must've", "must have"),
    ("mustn't", "must not"),
    ("needn't", "need not"),
    ("o'clock", "oclock"),
    ("oughtn't", "ought not"),
    ("shan't", "shall not"),
    ("she'd", "she would"),
    ("she'll", "she will"),
    ("she's", "she is"),
    ("should've", "should have"),
    ("shouldn't", "should not"),
    ("so've", "so have"),
    ("so's", "so as"),
    ("that'd", "that would"),
    ("that's", "that is"),
    ("there'd", "there would"),
    ("there's", "there is"),
    ("they'd", "they would"),
    ("they'll", "they will"),
    ("theyll", "they will"),
    ("they're", "they are"),
    ("theyre", "they are"),
    ("they've", "they have"),
    ("wasn't", "was not"),
    ("we'd", "we would"),
    ("we'll", "we will"),
    ("we're", "we are"),
    ("we've", "we have"),
    ("weren't", "were not"),
    ("what'll", "what will"),
    ("what're", "what are"),
    ("what's", "what is"),
    ("whats", "what is"),
    ("what've", "what have"),
    ("when's", "when is"),
    ("whens", "when is"),
    ("when've", "when have"),
    ("where'd", "where did"),
    ("where's", "where is"),
    ("who'll", "who will"),
    ("who's", "who is"),
    ("whos r", "who is r"),
    ("who've", "who have"),
    ("why's", "why is"),
    ("won't", "will not"),
    ("wont", "will not"),
    ("would've", "would have"),
    ("wouldn't", "would not"),
    ("y'all", "yall"),
    ("you'd", "you would"),
    ("youd", "you would"),
    ("you'll", "you will"),
    ("you're", "you are"),
    ("you've", "you have"),
]

# Numeric constants of the statistics.
MIN_LINE_CHARS = 5           # a raw line is used only if longer than 4 visible chars (+ newline)
TFIDF_CUTOFF_PCT = 30        # per-artist percentile cut-off of the streaming tf-idf filter
OUTLIER_LO_PCT, OUTLIER_HI_PCT = 2, 98
EXTRA_TRAINING_MIN_TFIDF = 0.0299
RARE_ARTIST_SHARE = 0.4
RARE_MIN_FREQ = 5
CLOUD_MAX_WORDS = 120
CLOUD_MIN_WORD_LEN = 4
TFIDF_HIST_MIN, TF_HIST_MIN, HIST_BIN_WIDTH = 0.0006, 0.002, 0.0002
COMPARE_BINS = 200
INGEST_MIN_CHARS = 80
TITLE_URL_PREFIX_CHARS = 19  # title = url[19:-7]
TITLE_URL_SUFFIX_CHARS = 7

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def char_map_from_to() -> tuple[str, str]:
    """CHAR_CONVERSION as a (from, to) pair for ``translate``; deletions go last."""
    keep = [(a, b) for a, b in CHAR_CONVERSION if b]
    drop = [a for a, b in CHAR_CONVERSION if not b]
    return "".join(a for a, _ in keep) + "".join(drop), "".join(b for _, b in keep)


def composed_char_map() -> tuple[str, str]:
    """CHAR_CONVERSION followed by the quote/dash map as ONE (from, to) pair.

    Exact composition: every character is sent through the first map, then
    the second; characters the first map already handles keep its result
    unless the second map changes that result (it never does: its targets of
    the first map's outputs are identities)."""
    m1 = {a: b for a, b in CHAR_CONVERSION}
    m2 = {}
    for a, b in zip(QUOTEDASH_FROM, QUOTEDASH_TO):
        m2.setdefault(a, b)

    def apply(c: str) -> str:
        out = m1.get(c, c)
        return "".join(m2.get(x, x) for x in out)

    keep, drop = [], []
    for c in list(dict.fromkeys(list(m1) + list(m2))):
        r = apply(c)
        if r == c:
            continue
        assert len(r) <= 1
        (keep if r else drop).append((c, r))
    return "".join(a for a, _ in keep) + "".join(a for a, _ in drop), "".join(b for _, b in keep)
