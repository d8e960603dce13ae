"""String predicates and small text conversions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import col
from .stemming import stem, stem_column

# fixed values: English words carrying no meaning in a word search
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do",
    "does", "doing", "don", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "him", "himself", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once",
    "only", "or", "other", "our", "out", "over", "own", "s", "same", "she", "should", "so", "some", "such",
    "t", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those",
    "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "will", "with", "you", "your",
)


def matches(text, pattern: str) -> Column:
    """Whether a regular expression is found in the text."""
    return col(text).rlike(pattern)


def like_nocase(text, pattern: str) -> Column:
    """LIKE without regard to case."""
    return col(text).ilike(pattern)


def hashlist_has(hashlist, item) -> Column:
    """Whether the lower-cased item is in a #-joined list (stored in lower case)."""
    item = F.lit(item) if isinstance(item, str) else item
    return F.array_contains(F.split(col(hashlist), "#"), F.lower(item))


_WORD = "[a-z0-9_]+"


def query_words(query: str) -> list[str]:
    """The words of a query in lower case, stop words off."""
    return [w for w in re.findall(_WORD, query.lower()) if w not in STOP_WORDS]


def words_of(text) -> Column:
    """The words of a text in lower case, as an array."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"({_WORD})"), F.lit(1))


def _has_stem(lowered: Column, word: str) -> Column:
    """Whether a word with the stem of ``word`` occurs: only words that begin like the stem are stemmed."""
    wanted = stem(word)
    begin = re.escape(wanted[:max(1, len(wanted) - 2)])
    pattern = rf"(?<![a-z0-9_])({begin}[a-z0-9_]*)"
    like = F.array_distinct(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1)))
    return lowered.rlike(pattern) & F.exists(like, lambda w: stem_column(w) == wanted)


def has_words(text, query: str, stemmed: bool = True) -> Column:
    """Whether all words of the query (stop words off) occur in the text, by their stems or as they are.

    One pattern search per query word; only words that begin like a stem are taken out and stemmed.  Without query words
    nothing matches.  ``operators.wordindex`` answers the same from an index.
    """
    wanted = query_words(query)
    text = col(text)
    if not wanted:
        return F.when(text.isNotNull(), F.lit(False))
    lowered = F.lower(text)
    tests = (_has_stem(lowered, w) if stemmed else lowered.rlike(rf"(?<![a-z0-9_]){re.escape(w)}(?![a-z0-9_])") for w in wanted)
    return reduce(lambda a, b: a & b, tests)


def has_words_in_any(columns, query: str, stemmed: bool = True) -> Column:
    """Word search over several columns taken as one document."""
    return has_words(F.concat_ws(" ", *map(col, columns)), query, stemmed)


def remove_blanks(text) -> Column:
    return F.regexp_replace(col(text), " ", "")


def path_key(text) -> Column:
    """A flat name of a path that is safe in URLs and file systems."""
    encoded = F.regexp_replace(F.base64(F.encode(col(text), "UTF-8")), r"[\r\n]", "")
    return F.translate(encoded, "+/", "$!")


_TIME_CODES = "HMS"


def _percent_regex(template: str) -> tuple[str, list[str]]:
    """Regular expression with one group per %-conversion, and the codes in order."""
    pieces, codes = re.split(r"(%\w)", template), []
    out = []
    for i, piece in enumerate(pieces):
        if not piece.startswith("%"):
            out.append(re.sub(r"([^\w\s])", r"\\\1", piece))
            continue
        codes.append(piece[1])
        adjacent = i + 2 < len(pieces) and pieces[i + 1] == ""
        if adjacent and piece[1] not in _TIME_CODES:
            raise ValueError(f"{piece}: conversions need a literal between them")
        out.append("(..)" if adjacent else "(.*?)")
    return "^" + "".join(out) + "$", codes


def percent_part(text, template: str, code: str) -> Column:
    """The part of a text a conversion stands for; NULL where the template does not fit."""
    pattern, codes = _percent_regex(template)
    text = col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, codes.index(code) + 1))


def percent_parts(text, template: str) -> Column:
    """All parts as a struct with one field per conversion."""
    _, codes = _percent_regex(template)
    return F.struct(*(percent_part(text, template, c).alias(c) for c in codes))


# fixed pattern of nineteen-character bibliographic codes
BIBCODE = r"^[012]\d\d\d\w[^ ]{14}$"


def is_bibcode(text) -> Column:
    return col(text).rlike(BIBCODE)


def strip_tags(text) -> Column:
    """Text without markup tags; NULL becomes empty."""
    return F.coalesce(F.regexp_replace(col(text), "<[^>]*>", ""), F.lit(""))
