"""Text expressions: word counts, widths, fingerprints, intent and competition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rankloom import lookups as L


# White space of any script.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# The same characters one by one.
SPACES = " \t\n\u000b\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words. White space becomes a plain blank first, so that no pattern is matched."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def word_count(text: Column) -> Column:
    """Number of words."""
    return F.array_size(words(text))


def squeeze(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def pixel_width(text: Column) -> Column:
    narrow = F.regexp_count(text, F.lit(L.NARROW_GLYPHS))
    wide = F.regexp_count(text, F.lit(L.WIDE_GLYPHS))
    return 7.5 * F.length(text) - 3.0 * narrow + 3.0 * wide


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def quoted(needle: Column) -> Column:
    """The needle as a literal pattern."""
    return F.regexp_replace(needle, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def whole_word(needle: Column) -> Column:
    """Pattern that matches the needle as whole words; letters of any script are word characters."""
    return F.concat(F.lit(r"(?U)\b"), quoted(needle), F.lit(r"\b"))


def in_text(needle: Column, text: Column) -> Column:
    return (needle != "") & F.rlike(text, whole_word(needle))


def density_substring(needle: Column, text: Column) -> Column:
    """Percent of words, counting occurrences anywhere in the text."""
    n = word_count(text)
    return F.when((needle == "") | (n == 0), 0.0).otherwise(100.0 * count_of(F.lower(text), F.lower(needle)) / n)


def density_containing(needle: Column, text: Column) -> Column:
    """Percent of words that contain the needle."""
    all_words = words(F.lower(text))
    hits = F.size(F.filter(all_words, lambda w: F.contains(w, F.lower(needle))))
    share = F.round(100.0 * hits / F.size(all_words), 2)
    return F.when((needle == "") | (F.size(all_words) == 0), 0.0).otherwise(share)


def density_whole_word(needle: Column, text: Column) -> Column:
    """Percent of the tokens of three letters or more, counting whole-word matches."""
    body = squeeze(text)
    tokens = F.greatest(F.regexp_count(body, F.lit("[a-z]{3,}")), F.lit(1))
    return F.round(100.0 * F.regexp_count(body, whole_word(needle)) / tokens, 2)


def any_phrase(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def search_intent(keyword: Column) -> Column:
    """Transactional, then navigational, then commercial; everything else informs."""
    kw = F.lower(F.trim(keyword))
    kw_words = F.split(kw, r"\s+")

    def hit(vocabulary: list[str], phrases: list[str]) -> Column:
        return F.arrays_overlap(kw_words, F.array(*map(F.lit, vocabulary))) | any_phrase(kw, phrases)

    return (
        F.when(F.coalesce(kw, F.lit("")) == "", "informational")
        .when(hit(L.TRANSACTIONAL_WORDS, L.TRANSACTIONAL_PHRASES), "transactional")
        .when(hit(L.NAVIGATIONAL_WORDS, L.NAVIGATIONAL_PHRASES), "navigational")
        .when(hit(L.COMMERCIAL_WORDS, L.COMMERCIAL_PHRASES), "commercial")
        .otherwise("informational")
    )


def competition(keywords: Column) -> Column:
    """Estimated competition of a keyword list."""
    text = F.lower(F.array_join(keywords, " "))
    lengths = F.aggregate(keywords, F.lit(0), lambda acc, k: acc + F.size(words(k)))
    low = reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in L.LOW_COMPETITION])
    return (
        F.when(F.size(keywords) == 0, "Medium")
        .when(any_phrase(text, L.HIGH_COMPETITION), "High")
        .when(low, "Low")
        .when(lengths / F.size(keywords) >= 3, "Low")
        .otherwise("Medium")
    )


def token_hash(token: Column) -> Column:
    """First 64 bits of the token's md5 as a signed long."""
    digest = F.md5(token.cast("binary"))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return F.round(1.0 - hamming(a, b) / 64.0, 4)
