"""Text expressions: tokens, snippets, canonical addresses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "in", "is",
    "it", "its", "not", "of", "on", "or", "she", "so", "that", "the", "their", "this", "to", "was", "we", "were", "will", "with", "you",
)
INJECTION_ANY_CASE = (r"\[INST\]", r"\[/INST\]", r"<\|system\|>", r"<\|user\|>", r"<\|assistant\|>", r"<\|im_start\|>", r"<\|im_end\|>", r"<\|endoftext\|>", r"<<SYS>>", r"<</SYS>>", r"\[SYSTEM\]")
INJECTION_EXACT = (r"\bHuman:\s", r"\bAssistant:\s")
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{feff}\x{2060}-\x{2064}\x{206a}-\x{206f}]"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "via")


def _folds() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter with marks, and that letter; after them all marks, for which nothing stands. Hangul syllables come apart into letters, so they stay."""
    letters, marks = {}, []
    for c in map(chr, range(0x80, 0x110000)):
        kind = unicodedata.category(c)
        if kind == "Mn":
            marks.append(c)
        elif kind[0] == "L":
            bare = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
            if len(bare) == 1 and bare[0] != c:
                letters[c] = bare[0]
    return "".join([*letters, *marks]), "".join(letters.values())


#: For ``translate``: what stands for nothing in PLAIN is taken out.
ACCENTED, PLAIN = _folds()
_FOLD = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])


def folded(word: str) -> str:
    """As the index has it, on the driver."""
    return word.lower().translate(_FOLD)


def tokens(text: Column) -> Column:
    """ASCII letter and digit runs in lower case, without stopwords."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: ~t.isin("", *STOPWORDS))  # a set; an array would be gone through for each token


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: letters, digits, hyphen and underscore; marks taken off all letters."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}_-]+"), lambda t: t != "")


def has_injection(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(INJECTION_ANY_CASE)) | text.rlike("|".join(INJECTION_EXACT))


def sanitized(text: Column, limit: int = 500) -> tuple[Column, Column]:
    """Text safe to show, and flags: injection_markers, truncated."""
    given = F.coalesce(text, F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(given, CONTROL, ""), ZERO_WIDTH, "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[\r\n]+", " "), " {2,}", " ")
    clean = F.replace(F.replace(F.regexp_replace(clean, r"^\s+|\s+$", ""), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    long = F.char_length(clean) > limit
    flags = F.array_compact(F.array(F.when(has_injection(given), F.lit("injection_markers")), F.when(long, F.lit("truncated"))))
    return F.when(long, F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))).otherwise(clean), flags


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, the rest sorted by key, no trailing slash except at the root. Null if it is no address."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?([^#]*))?", k)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(5)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(path == "", "/").otherwise(path)
    drop = F.array(*[F.lit(t) for t in TRACKING])
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(drop, F.lower(F.substring_index(p, "=", 1))))
    numbered = F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(numbered), lambda s: s["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    whole = F.when(whole.endswith("/") & (path != "/"), F.regexp_replace(whole, "/$", "")).otherwise(whole)
    return F.when(scheme != "", whole)
