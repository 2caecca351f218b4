"""Text expressions: normalisers, tokenizers, counts, CJK handling, byte-safe cuts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges of the characters that are indexed one by one.
CJK_RANGES = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x3040, 0x309F),
    (0x30A0, 0x30FF),
    (0xAC00, 0xD7AF),
    (0xF900, 0xFAFF),
    (0xFF00, 0xFFEF),
)
CJK_CLASS = "[" + "".join(rf"\x{{{low:04X}}}-\x{{{high:04X}}}" for low, high in CJK_RANGES) + "]"
#: Characters that a full-text query can't hold.
RESERVED = r'["()*:^]'
#: Given for a query without tokens; no page holds it.
NO_MATCH = '"__nothing_matches__"'


def strip(text: Column) -> Column:
    """Without white space (ASCII) at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def norm_text(text: Column) -> Column:
    """Lower-cased, with single spaces."""
    return F.array_join(split_words(F.lower(text)), " ")


def signature(line: Column) -> Column:
    """A line's form with each run of digits as one mark."""
    return norm_text(F.regexp_replace(line, r"[0-9]+", "#"))


def without_mojibake(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{0590}-\x{1CFF}]", "")


def word_tokens(text: Column) -> Column:
    """Lower-cased words; punctuation other than hyphens separates."""
    return split_words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\-]", " "))


def alnum_tokens(text: Column, cap: int | None = None) -> Column:
    """Lower-cased ASCII letters and digits, without LaTeX commands."""
    found = split_words(F.regexp_replace(F.lower(F.regexp_replace(text, r"\\[a-zA-Z]+", " ")), r"[^a-z0-9 ]", " "))
    return found if cap is None else F.slice(found, 1, cap)


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def count_substring(text: Column, needle: str) -> Column:
    """Occurrences that don't overlap."""
    return F.regexp_count(text, F.lit(re.sub(r"([^\w\s])", r"\\\1", needle)))


def contains_all(text: Column, tokens: list[str]) -> Column:
    low, found = F.lower(text), F.lit(bool(tokens))
    for token in tokens:
        found = found & F.contains(low, F.lit(token.lower()))
    return found


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct n-grams of an array of tokens, joined by spaces; none of fewer tokens."""
    from_each = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(from_each)).otherwise(F.array().cast("array<string>"))


def ngram_hashes(tokens: Column, n: int) -> Column:
    """The same as hashes of 64 bits: for counting, without building a string an n-gram."""
    def hashed(t: Column) -> Column:
        from_each = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.slice(t, i, n)))
        return F.when(F.size(t) >= n, F.array_distinct(from_each)).otherwise(F.array().cast("array<bigint>"))

    # Bound to a name first, so that an expression for the tokens is computed once and not at every place.
    return F.get(F.transform(F.array(tokens), hashed), 0)


def cjk_split(text: Column) -> Column:
    """Spaces around every CJK character; idempotent."""
    return F.array_join(split_words(F.regexp_replace(text, f"({CJK_CLASS})", " $1 ")), " ")


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit(CJK_CLASS))


def escape_query(query: Column) -> Column:
    """Tokens without reserved characters, each in quotes: a full-text conjunction."""
    cleaned = F.filter(F.transform(split_words(query), lambda w: F.regexp_replace(w, RESERVED, "")), lambda w: w != "")
    quoted = F.transform(cleaned, lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return F.when(F.size(cleaned) == 0, F.lit(NO_MATCH)).otherwise(F.array_join(quoted, " "))


def escape_query_cjk(query: Column) -> Column:
    """As escape_query, each token a phrase of its CJK characters."""
    phrases = F.filter(F.transform(split_words(query), lambda w: F.trim(F.regexp_replace(cjk_split(w), RESERVED, ""))), lambda w: w != "")
    return F.when(F.size(phrases) == 0, F.lit(NO_MATCH)).otherwise(F.array_join(F.transform(phrases, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " "))


def cjk_excerpt(text: Column, needle: Column, context: int) -> Column:
    """Text around the first place of the needle, dots where it is cut; null without one."""
    at = F.instr(text, needle) - 1
    half = F.greatest(F.floor((F.lit(context) - F.char_length(needle)) / 2), F.lit(0))
    start = F.greatest(at - half, F.lit(0)).cast("int")
    stop = F.least(at + F.char_length(needle) + half, F.char_length(text)).cast("int")
    middle = F.substring(text, start + 1, stop - start)
    return F.when(at >= 0, F.concat(F.when(start > 0, "...").otherwise(""), middle, F.when(stop < F.char_length(text), "...").otherwise("")))


def search_excerpt(text: Column, token: str, context: int) -> Column:
    """Text around the first place of a token, its edges moved to spaces within 50 characters."""
    low, size = F.lower(text), F.char_length(text)
    at = F.instr(low, F.lit(token.lower())) - 1
    start, stop = F.greatest(at - context // 2, F.lit(0)), F.least(at + len(token) + context // 2, size)
    from_left = F.greatest(start - 50, F.lit(0))
    left = F.substring(text, from_left + 1, start - from_left)
    last_space = F.char_length(left) - F.instr(F.reverse(left), F.lit(" "))  # its place in `left`, from 0
    snapped_start = F.when((start > 0) & (F.instr(left, F.lit(" ")) > 0) & (from_left + last_space > 0), from_left + last_space + 1).otherwise(start)
    first_space = F.instr(F.substring(text, stop + 1, F.lit(50)), F.lit(" "))
    snapped_stop = F.when((stop < size) & (first_space > 0), stop + first_space - 1).otherwise(stop)
    middle = F.substring(text, snapped_start + 1, snapped_stop - snapped_start)
    return strip(F.concat(F.when(snapped_start > 0, "...").otherwise(""), middle, F.when(snapped_stop < size, "...").otherwise("")))


def utf8_truncate(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within a number of UTF-8 bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit + 1)
    # A byte of the form 10xxxxxx at the limit continues a character that began before it: step back to its first byte.
    trimmed = F.lit(None).cast("string")
    for back in range(4):
        follows = F.substring(cut, limit + 1 - back, 1)
        is_start = ~F.hex(follows).rlike("^[89AB]")
        trimmed = F.coalesce(trimmed, F.when(is_start, F.decode(F.substring(cut, 1, limit - back), "UTF-8")))
    return F.when(F.octet_length(text) <= limit, text).otherwise(trimmed)


def porter_stem(word: str) -> str:
    """The stem of a lower-case English word by the algorithm published in 1980."""
    if len(word) <= 2:
        return word
    vowels = "aeiou"

    def consonant(w: str, i: int) -> bool:
        return w[i] not in vowels and not (w[i] == "y" and i > 0 and consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = re.sub(r"(.)\1+", r"\1", "".join("c" if consonant(w, i) else "v" for i in range(len(w))))
        return kinds.count("vc")

    def has_vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def short(w: str) -> bool:
        n = len(w)
        return n > 2 and consonant(w, n - 1) and not consonant(w, n - 2) and consonant(w, n - 3) and w[-1] not in "wxy"

    def swap(w: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
        for old, new in rules:
            if w.endswith(old):
                stem = w[: len(w) - len(old)]
                return stem + new if measure(stem) > least else w
        return w

    w = word
    # 1a: plurals; 1b: past and progressive; 1c: final y
    w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1] if w.endswith("s") else w
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and has_vowel(w[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                cut += "e"
            elif double(cut) and cut[-1] not in "lsz":
                cut = cut[:-1]
            elif measure(cut) == 1 and short(cut):
                cut += "e"
            w = cut
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # 2 and 3: double suffixes, fixed values
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    # 4: single suffixes, fixed values
    for suffix in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    # 5: final e and double l
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w
