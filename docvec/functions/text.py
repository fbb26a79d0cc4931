"""Text projections as native column expressions (no per-row Python).

Every function takes and returns a ``Column`` so that Catalyst keeps the whole
cleaning chain inside one whole-stage-codegen span next to the parquet scan.
The regular expressions avoid look-around so that the same rules can be
written for RE2 (DuckDB) in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (patterns, alphabets).
# ---------------------------------------------------------------------------
# e-mail address: runs of word characters, dots and dashes around an '@'
# (word character = Unicode letter, Unicode number or underscore).
EMAIL_PATTERN = r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+"
# keep-only alphabets, everything else becomes a space
ALPHABET_DEFAULT = r"[^a-zA-Z']"
ALPHABET_CLEAN = r"[^a-zA-Z'.?!]"
ALPHABET_TRANSFORMER = r"[^a-zA-Z0-9'.?!:;\"\-,]"
# the same without the space, which would be replaced by itself; Java tests the named class of letters several times as
# fast as a union of ranges
NOT_A_SPACE = {"default": r"[^\p{Alpha}' ]", "clean": r"[^\p{Alpha}'.?! ]", "transformer": r"[^\p{Alnum}'.?!:;\"\-, ]"}
# per-token removals of the word tokeniser, in this order
TOKEN_NEG_SUFFIX = r"n't( |$)"
TOKEN_CLITIC = r"'[a-z]{1,2}( |$)"
TOKEN_NON_LETTERS = r"[^a-z ]"
TOKEN_NON_LETTERS_KEEP_MARKS = r"[^a-z.?! ]"
# fused words the tokeniser splits into two tokens
FUSED_WORDS = (
    (r"\b(can)(not)\b", "$1 $2"),
    (r"\b(gon|wan)(na)\b", "$1 $2"),
    (r"\b(got)(ta)\b", "$1 $2"),
    (r"\b(lem|gim)(me)\b", "$1 $2"),
    (r"'t(is|was)\b", " $1"),
)
# all of them in one pass (a group that does not take part adds nothing), and the strings one of which a text needs
FUSED_ANY = r"\b(?:(can)(not)|(gon|wan)(na)|(got)(ta)|(lem|gim)(me))\b|'t(is|was)\b", "$1$3$5$7 $2$4$6$8$9"
FUSED_PARTS = ("cannot", "onna", "anna", "gotta", "lemme", "gimme", "'tis", "'twas")
# characters the Keras-style word splitter turns into spaces
KERAS_FILTERS = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]"
# vectoriser token: two or more word characters
VECTORIZER_TOKEN = r"[\p{L}\p{N}_]{2,}"
# sentence boundary: a terminator followed by whitespace; newlines also split
SENTENCE_BREAK = r"([.?!])\s+"

ALPHABETS = {
    "default": ALPHABET_DEFAULT,
    "clean": ALPHABET_CLEAN,
    "transformer": ALPHABET_TRANSFORMER,
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_to_empty(col) -> Column:
    """NULL text is treated as the empty string (rule of the rebuild)."""
    return F.coalesce(_c(col), F.lit(""))


def strip_email(col) -> Column:
    """Replace e-mail addresses by a space (the regex only runs on texts
    that contain an '@'; a fast substring test skips the rest)."""
    c = null_to_empty(col)
    return F.when(c.contains("@"), F.regexp_replace(c, EMAIL_PATTERN, " ")).otherwise(c)


def keep_chars(col, alphabet: str = "default") -> Column:
    """Every character outside the alphabet becomes a space."""
    return F.regexp_replace(_c(col), NOT_A_SPACE[alphabet], " ")


def collapse_ws(col) -> Column:
    """Runs of whitespace become one space."""
    return F.regexp_replace(_c(col), r"\s+", " ")


def clean_for_transformer(col) -> Column:
    """T4: T1 -> T2 (transformer alphabet) -> T3."""
    return collapse_ws(keep_chars(strip_email(col), "transformer"))


def _once(value: Column, fn) -> Column:
    """``fn`` of a value that is made once, however often ``fn`` names it: an
    expression named twice is evaluated twice, a lambda's variable is not."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _split_fused(col: Column) -> Column:
    def split(t: Column) -> Column:
        found = t.contains(FUSED_PARTS[0])
        for part in FUSED_PARTS[1:]:
            found = found | t.contains(part)
        return F.when(found, F.regexp_replace(t, F.lit(FUSED_ANY[0]), F.lit(FUSED_ANY[1]))).otherwise(t)

    return _once(col, split)


def _strip_text(t: Column, keep_marks: bool = False) -> Column:
    """The per-token removals applied to the whole space-separated string at
    once (same result: every pattern is anchored at a token end and never
    spans a space), so they run as three code-generated regex passes instead
    of three interpreted lambdas per token."""
    t = F.regexp_replace(t, TOKEN_NEG_SUFFIX, "$1")
    t = F.regexp_replace(t, TOKEN_CLITIC, "$1")
    return F.regexp_replace(t, TOKEN_NON_LETTERS_KEEP_MARKS if keep_marks else TOKEN_NON_LETTERS, "")


def _strip_letters(t: Column) -> Column:
    """``_strip_text`` of a text of a-z, spaces and apostrophes: without an
    apostrophe there is nothing to take off, and no other character to drop."""
    def strip(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(x, TOKEN_NEG_SUFFIX, "$1"), TOKEN_CLITIC, "$1")
        return F.when(x.contains("'"), F.replace(y, F.lit("'"), F.lit(""))).otherwise(x)

    return _once(t, strip)


def _tokens_of_text(t: Column, keep_marks: bool = False) -> Column:
    return F.filter(F.split(_strip_text(t, keep_marks), " "), lambda w: F.length(w) > 1)


def base_tokens(col) -> Column:
    """The word tokeniser's net effect on the default alphabet.

    T1, T2, lower, split fused words, split on spaces, then per token drop a
    trailing n't, a trailing clitic and every non-letter; keep length > 1."""
    t = F.lower(keep_chars(strip_email(col), "default"))
    return F.filter(F.split(_strip_letters(_split_fused(t)), " "), lambda w: F.length(w) > 1)


def remove_words(arr: Column, words) -> Column:
    """T12 with a literal (size-checked) word list: tokens not in the list."""
    words = list(words)
    if not words:
        return arr
    return F.filter(arr, lambda w: ~w.isin(words))


def clean_string_tokens(col) -> Column:
    """T14 tokens: alphabet keeps ``.?!``; '?' and '!' and a token-final '.'
    are split off as one-character tokens (and so dropped by the length
    rule), an ellipsis stays a token."""
    t = F.lower(keep_chars(strip_email(col), "clean"))
    t = _split_fused(t)
    t = F.regexp_replace(t, r"\.\.\.", " ... ")
    t = F.regexp_replace(t, r"([?!])", " $1 ")
    t = F.regexp_replace(t, r"([^. ])\.( |$)", "$1 . $2")
    return _tokens_of_text(t, keep_marks=True)


def clean_string(col) -> Column:
    """clean_string = tokens joined by one space."""
    return F.array_join(clean_string_tokens(col), " ")


def sentences(col) -> Column:
    """T16 (b): split after '.', '?' or '!' followed by whitespace and at line
    breaks; pieces without a non-space character are dropped."""
    t = F.regexp_replace(null_to_empty(col), SENTENCE_BREAK, "$1\n")
    return F.filter(F.split(t, "\n"), lambda s: s.rlike(r"\S"))


def dot_sentences(col) -> Column:
    """T16 (a): plain split on '.'."""
    return F.split(null_to_empty(col), r"\.")


def keras_words(col) -> Column:
    """Lower, filter characters to spaces, split on space, drop empties."""
    t = F.regexp_replace(F.lower(null_to_empty(col)), KERAS_FILTERS, " ")
    return F.filter(F.split(t, " "), lambda w: w != "")


def vectorizer_terms(col) -> Column:
    """Runs of two or more word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(null_to_empty(col)), F.lit(VECTORIZER_TOKEN), 0)


# ---------------------------------------------------------------------------
# Dictionary steps with literal (size-checked) dictionaries.  Table-supplied
# dictionaries go through ``docvec.operators.dictionaries``.
# ---------------------------------------------------------------------------
PHRASE_GLUE = "\u0001"


def _map_literal(d: dict) -> Column:
    keys = list(d.keys())
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                             F.array(*[F.lit(d[k]) for k in keys]))


def expand_contractions(text: Column, contractions: dict) -> Column:
    """T5: word-wise replacement of contracted forms (lower-case keys)."""
    m = _map_literal(contractions)
    return F.array_join(
        F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")


def merge_phrases(arr: Column, phrases) -> Column:
    """Merge consecutive tokens that form a listed phrase into one
    space-joined token; longer phrases first, left to right, no overlap.

    Every token is padded by its own spaces, so a plain string replace finds
    whole-token matches without look-around."""
    s = F.concat(F.lit(" "), F.array_join(arr, "  "), F.lit(" "))
    for ph in sorted(phrases, key=lambda p: (-len(p), p)):
        s = F.replace(s, F.lit(" " + "  ".join(ph) + " "), F.lit(" " + PHRASE_GLUE.join(ph) + " "))
    parts = F.filter(F.split(s, " +"), lambda w: w != "")
    return F.transform(parts, lambda w: F.replace(w, F.lit(PHRASE_GLUE), F.lit(" ")))


def lemmatize(arr: Column, lemmas) -> Column:
    """Noun, then verb, then adjective look-up; unknown forms unchanged."""
    maps = []
    for pos in ("n", "v", "a"):
        d = {f: l for f, p, l in lemmas if p == pos}
        maps.append(_map_literal(d) if d else None)

    def chain(w):
        for m in maps:
            if m is not None:
                w = F.coalesce(F.try_element_at(m, w), w)
        return w

    return F.transform(arr, chain)


def preprocess(col, remove_stopwords: bool = False, stopwords=None,
               contractions: dict | None = None, phrases=None, lemmas=None) -> Column:
    """The full token pipeline with its optional dictionary steps, in the
    reference order: e-mail, alphabet, contractions, tokeniser, per-token
    strip, drop empty, phrases, lower/length, stop words, lemmas."""
    t = F.lower(keep_chars(strip_email(col), "default"))
    if contractions:
        t = expand_contractions(t, contractions)
    t = _split_fused(t)
    # a dictionary's expansions may hold any character
    arr = F.split(_strip_text(t) if contractions else _strip_letters(t), " ")
    if phrases:
        arr = merge_phrases(F.filter(arr, lambda w: w != ""), phrases)
    arr = F.filter(arr, lambda w: F.length(w) > 1)
    if remove_stopwords:
        from docvec.functions.dictionaries import ENGLISH_STOP_WORDS
        arr = remove_words(arr, ENGLISH_STOP_WORDS if stopwords is None else stopwords)
    if lemmas:
        arr = lemmatize(arr, lemmas)
    return arr


def preprocess_string(col, **flags) -> Column:
    """T15 string wrapper: tokens joined by one space."""
    return F.array_join(preprocess(col, **flags), " ")
