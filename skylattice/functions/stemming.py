"""English stems by suffix stripping in steps (M. F. Porter, "An algorithm for suffix stripping", 1980).

The rules are data: a step has suffixes with what replaces them and a condition on what stands before; the longest
suffix that a word ends with decides.  Conditions count the vowel-consonant sequences of the rest.  The same rules run on a Python
string (``stem``) and on a column (``stem_column``).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# a group of consonants, one of vowels; y is a vowel after a consonant
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME = f"^(?:{_C})?{_V}{_C}"  #: one sequence or more
_ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
_MORE = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
_VOWEL = f"^(?:{_C})?[aeiouy]"
_SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"  #: consonant, vowel, consonant, the last one none of w, x, y

# fixed values: suffixes of the published steps and what replaces them
_PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
_DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_LATE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LAST_SUFFIXES = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate",
                  "iti", "ous", "ive", "ize")


def _ending(suffixes) -> str:
    return f"^(.*?)({'|'.join(suffixes)})$"


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with other characters than a to z and those of one or two letters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word

    def replaced(word: str, suffixes: dict, condition: str) -> str:
        found = re.match(_ending(suffixes), word)
        return found[1] + suffixes[found[2]] if found and re.search(condition, found[1]) else word

    word = replaced(word, _PLURALS, "")
    if word.endswith("eed"):
        word = replaced(word, {"eed": "ee"}, _SOME)
    elif (cut := replaced(word, {"ed": "", "ing": ""}, _VOWEL)) != word:
        if re.search("(?:at|bl|iz)$", cut):
            word = cut + "e"
        elif re.search(r"([^aeiouylsz])\1$", cut):
            word = cut[:-1]
        else:
            word = cut + "e" if re.search(_ONE, cut) and re.search(_SHORT_END, cut) else cut
    word = replaced(word, {"y": "i"}, _VOWEL)
    word = replaced(word, _DOUBLE_SUFFIXES, _SOME)
    word = replaced(word, _LATE_SUFFIXES, _SOME)
    found = re.match(_ending([*_LAST_SUFFIXES, "(?<=[st])ion"]), word)
    if found and re.search(_MORE, found[1]):
        word = found[1]
    if word.endswith("e"):
        rest = word[:-1]
        if re.search(_MORE, rest) or re.search(_ONE, rest) and not re.search(_SHORT_END, rest):
            word = rest
    return word[:-1] if word.endswith("ll") and re.search(_MORE, word[:-1]) else word


def _then(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stem_column(word: Column) -> Column:
    """The stem of lower-case words, as ``stem`` gives it."""
    def replaced(suffixes: dict, condition: str):
        pattern = _ending(suffixes)
        replacements = F.create_map(*(F.lit(x) for pair in suffixes.items() for x in pair))

        def apply(w: Column) -> Column:
            rest, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
            fits = (suffix != "") & rest.rlike(condition) if condition else suffix != ""
            return F.when(fits, F.concat(rest, F.element_at(replacements, suffix))).otherwise(w)
        return apply

    def past(w: Column) -> Column:
        def mended(both: Column) -> Column:
            old, cut = both["w"], both["cut"]
            return (F.when(old == cut, old).when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e")))
                    .when(cut.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(cut, ".$", ""))
                    .when(cut.rlike(_ONE) & cut.rlike(_SHORT_END), F.concat(cut, F.lit("e"))).otherwise(cut))

        cut = F.struct(w.alias("w"), replaced({"ed": "", "ing": ""}, _VOWEL)(w).alias("cut"))
        return F.when(w.endswith("eed"), replaced({"eed": "ee"}, _SOME)(w)).otherwise(_then(cut, mended))

    def last(w: Column) -> Column:
        pattern = _ending([*_LAST_SUFFIXES, "(?<=[st])ion"])
        rest = F.regexp_extract(w, pattern, 1)
        return F.when(w.rlike(pattern) & rest.rlike(_MORE), rest).otherwise(w)

    def silent(w: Column) -> Column:
        rest = F.regexp_replace(w, "e$", "")
        goes = rest.rlike(_MORE) | rest.rlike(_ONE) & ~rest.rlike(_SHORT_END)
        return F.when(w.endswith("e") & goes, rest).otherwise(w)

    def single(w: Column) -> Column:
        rest = F.regexp_replace(w, "l$", "")
        return F.when(w.endswith("ll") & rest.rlike(_MORE), rest).otherwise(w)

    out = word
    for step in (replaced(_PLURALS, ""), past, replaced({"y": "i"}, _VOWEL), replaced(_DOUBLE_SUFFIXES, _SOME),
                 replaced(_LATE_SUFFIXES, _SOME), last, silent, single):
        out = _then(out, step)
    return F.when((F.length(word) < 3) | ~word.rlike("^[a-z]+$"), word).otherwise(out)


def stem_sql(word: str) -> str:
    """SQL for the stem of a lower-case word that an expression names, as ``stem`` gives it."""
    def then(value: str, name: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def quoted(pattern: str) -> str:
        return "r'" + pattern + "'"

    def replaced(w: str, suffixes: dict, condition: str) -> str:
        pattern = quoted(_ending(suffixes))
        rest, suffix = f"regexp_extract({w}, {pattern}, 1)", f"regexp_extract({w}, {pattern}, 2)"
        fits = f"{suffix} <> ''" + (f" AND {rest} RLIKE {quoted(condition)}" if condition else "")
        pairs = ", ".join(f"'{a}', '{b}'" for a, b in suffixes.items())
        return f"CASE WHEN {fits} THEN concat({rest}, element_at(map({pairs}), {suffix})) ELSE {w} END"

    short = f"u RLIKE {quoted(_ONE)} AND u RLIKE {quoted(_SHORT_END)}"
    mended = (f"CASE WHEN u = w2 THEN w2 WHEN u RLIKE '(?:at|bl|iz)$' THEN concat(u, 'e') WHEN u RLIKE {quoted(r'([^aeiouylsz])\1$')} "
              f"THEN regexp_replace(u, '.$', '') WHEN {short} THEN concat(u, 'e') ELSE u END")
    past = f"CASE WHEN endswith(w2, 'eed') THEN {replaced('w2', {'eed': 'ee'}, _SOME)} ELSE {then(replaced('w2', {'ed': '', 'ing': ''}, _VOWEL), 'u', mended)} END"
    pattern = quoted(_ending([*_LAST_SUFFIXES, "(?<=[st])ion"]))
    last = f"CASE WHEN w6 RLIKE {pattern} AND regexp_extract(w6, {pattern}, 1) RLIKE {quoted(_MORE)} THEN regexp_extract(w6, {pattern}, 1) ELSE w6 END"
    bare = "regexp_replace(w7, 'e$', '')"
    silent = (f"CASE WHEN endswith(w7, 'e') AND ({bare} RLIKE {quoted(_MORE)} OR {bare} RLIKE {quoted(_ONE)} AND NOT {bare} RLIKE {quoted(_SHORT_END)}) "
              f"THEN {bare} ELSE w7 END")
    single = f"CASE WHEN endswith(w8, 'll') AND regexp_replace(w8, 'l$', '') RLIKE {quoted(_MORE)} THEN regexp_replace(w8, 'l$', '') ELSE w8 END"
    out = word
    for name, body in (("w1", replaced("w1", _PLURALS, "")), ("w2", past), ("w3", replaced("w3", {"y": "i"}, _VOWEL)),
                       ("w4", replaced("w4", _DOUBLE_SUFFIXES, _SOME)), ("w5", replaced("w5", _LATE_SUFFIXES, _SOME)),
                       ("w6", last), ("w7", silent), ("w8", single)):
        out = then(out, name, body)
    return f"CASE WHEN length({word}) < 3 OR NOT {word} RLIKE '^[a-z]+$' THEN {word} ELSE {out} END"
