"""DuckDB SQL spellings of the text rules, used only to write the oracle SQL
that checks the Spark queries.  Each function mirrors the column function of
the same name in ``docvec.functions.text``."""

from __future__ import annotations

from docvec.functions.dictionaries import ENGLISH_STOP_WORDS

# The rules once more, written for RE2: the oracle does not import the patterns that it checks.
EMAIL = r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+"
KEPT = {"default": "[^a-zA-Z']", "clean": "[^a-zA-Z'.?!]", "transformer": r"""[^a-zA-Z0-9'.?!:;"\-,]"""}
SPLIT_WORDS = (
    (r"\b(can)(not)\b", r"\1 \2"),
    (r"\b(gon|wan)(na)\b", r"\1 \2"),
    (r"\b(got)(ta)\b", r"\1 \2"),
    (r"\b(lem|gim)(me)\b", r"\1 \2"),
    (r"'t(is|was)\b", r" \1"),
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def rx(x: str, pattern: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(rep)}, 'g')"


def null_to_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def strip_email(x: str) -> str:
    return rx(null_to_empty(x), EMAIL, " ")


def keep_chars(x: str, alphabet: str = "default") -> str:
    return rx(x, KEPT[alphabet], " ")


def collapse_ws(x: str) -> str:
    return rx(x, r"\s+", " ")


def clean_for_transformer(x: str) -> str:
    return collapse_ws(keep_chars(strip_email(x), "transformer"))


def lower_default(x: str) -> str:
    return f"lower({keep_chars(strip_email(x), 'default')})"


def split_fused(x: str) -> str:
    for pat, rep in SPLIT_WORDS:
        x = rx(x, pat, rep)
    return x


def token_strip(arr: str, keep_marks: bool = False) -> str:
    inner = rx(rx(rx("w", "n't$", ""), "'[a-z]{1,2}$", ""), "[^a-z.?!]" if keep_marks else "[^a-z]", "")
    return f"list_transform({arr}, lambda w: {inner})"


def base_tokens(x: str) -> str:
    t = split_fused(f"lower({keep_chars(strip_email(x), 'default')})")
    return f"list_filter({token_strip(f'string_split({t}, {q(chr(32))})')}, lambda w: length(w) > 1)"


def remove_words(arr: str, words=ENGLISH_STOP_WORDS) -> str:
    return f"list_filter({arr}, lambda w: NOT list_contains({str_list(words)}, w))"


def clean_string_tokens(x: str) -> str:
    t = split_fused(f"lower({keep_chars(strip_email(x), 'clean')})")
    t = rx(t, r"\.\.\.", " ... ")
    t = rx(t, r"([?!])", " \\1 ")
    t = rx(t, r"([^. ])\.( |$)", "\\1 . \\2")
    return f"list_filter({token_strip(f'string_split({t}, {q(chr(32))})', True)}, lambda w: length(w) > 1)"


def clean_string(x: str) -> str:
    return f"array_to_string({clean_string_tokens(x)}, ' ')"


def sentences(x: str) -> str:
    t = f"regexp_replace({null_to_empty(x)}, {q(r"([.?!])\s+")}, '\\1' || chr(10), 'g')"
    return f"list_filter(string_split({t}, chr(10)), lambda s: regexp_matches(s, '\\S'))"


def keras_words(x: str) -> str:
    t = rx(f"lower({null_to_empty(x)})", r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]""", " ")
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def vectorizer_terms(x: str) -> str:
    return f"regexp_extract_all(lower({null_to_empty(x)}), {q(r"[\p{L}\p{N}_]{2,}")})"


def map_lookup(keys_vals: dict, w: str) -> str:
    m = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in keys_vals.items()) + "}"
    return f"coalesce({m}[{w}], {w})"


def expand_contractions(t: str, contractions: dict) -> str:
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: {map_lookup(contractions, 'w')}), ' ')"


def merge_phrases(arr: str, phrases) -> str:
    s = f"' ' || array_to_string({arr}, '  ') || ' '"
    for ph in sorted(phrases, key=lambda p: (-len(p), p)):
        s = f"replace({s}, {q(' ' + '  '.join(ph) + ' ')}, {q(' ' + chr(1).join(ph) + ' ')})"
    parts = f"list_filter(regexp_split_to_array({s}, ' +'), lambda w: w <> '')"
    return f"list_transform({parts}, lambda w: replace(w, chr(1), ' '))"


def lemmatize(arr: str, lemmas) -> str:
    expr = "w"
    for pos in ("n", "v", "a"):
        d = {f: l for f, p, l in lemmas if p == pos}
        if d:
            expr = map_lookup(d, f"({expr})")
    return f"list_transform({arr}, lambda w: {expr})"


def preprocess(x: str, remove_stopwords: bool = False, stopwords=None, contractions=None,
               phrases=None, lemmas=None) -> str:
    t = f"lower({keep_chars(strip_email(x), 'default')})"
    if contractions:
        t = expand_contractions(t, contractions)
    t = split_fused(t)
    arr = f"list_filter({token_strip(f'string_split({t}, {q(chr(32))})')}, lambda w: w <> '')"
    if phrases:
        arr = merge_phrases(arr, phrases)
    arr = f"list_filter({arr}, lambda w: length(w) > 1)"
    if remove_stopwords:
        arr = remove_words(arr, ENGLISH_STOP_WORDS if stopwords is None else stopwords)
    if lemmas:
        arr = lemmatize(arr, lemmas)
    return arr


def md5_hash(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
