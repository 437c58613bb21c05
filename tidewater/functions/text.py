"""Text predicates and transformations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the normaliser keeps; every other becomes a blank.
KEPT = "\\x{20}-\\x{7E}\\n\\x{A0}-\\x{2AF}\\x{300}-\\x{36F}\\x{1E00}-\\x{1EFF}"


def letter_ratio(text: Column) -> Column:
    """Letters over characters; NULL for an empty text."""
    return F.regexp_count(text, F.lit("\\p{L}")) / F.nullif(F.length(text), F.lit(0))


def is_gibberish(text: Column, least: float = 0.65) -> Column:
    """True for missing and empty texts and those with too few letters; blanks count against it."""
    return F.coalesce(letter_ratio(text) < least, F.lit(True))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def normalize_text(text: Column) -> Column:
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.regexp_replace(text, f"[^{KEPT}]", " ")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "\\n{3,}", "\n\n")
    return strip(text)


def truncate_at_sentence(text: Column, limit: int) -> Column:
    """At most `limit` characters: up to the last sentence end, else the last blank, else cut hard."""
    head = F.left(text, F.lit(limit))
    sentence = F.regexp_extract(head, "(?s)^(.*[.!?]\\s+)", 1)
    word = F.regexp_extract(head, "(?s)^(.+) ", 1)
    cut = F.when(sentence != "", sentence).when(word != "", word).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(strip(cut))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-grams of characters of the lower-cased, stripped text; a shorter text is its own."""
    text = strip(F.lower(text))
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    grams = chars
    for k_ in range(1, k):  # each step appends the next character; positions past the end become NULL
        grams = F.zip_with(grams, F.slice(chars, F.lit(k_ + 1), F.greatest(F.size(chars) - k_, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(F.filter(grams, lambda g: g.isNotNull())))


#: Characters whose k-grams are numbered at once; a longer text is a piece of its own.
PIECE = 1 << 20


def distinct_grams(texts: list[str], k: int) -> list[int]:
    """How many distinct k-grams of characters each text has, 1 if it is shorter. Grams are numbered, not hashed, so counts are exact."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        points = np.frombuffer("".join(texts[start:end]).encode("utf-32-le"), dtype=np.uint32)
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        code = (np.cumsum(seen) - 1)[points]
        base = int(seen.sum())
        grams, n = code, base
        for _ in range(k - 1):
            if n * base >= 1 << 63:
                own, grams = np.unique(grams, return_inverse=True)
                n = len(own)
            code = code[1:]
            grams = grams[: len(code)] * base + code
            n *= base
        first = 0
        for text in texts[start:end]:
            if len(text) < k:
                out.append(1)
            else:
                own = np.sort(grams[first : first + len(text) - k + 1])
                out.append(1 + int((own[1:] != own[:-1]).sum()))
            first += len(text)
        start = end
    return out


def shingle_count(text: Column, k: int = 5) -> Column:
    """The size of shingles(text, k), without its strings."""

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], pa.int32())]
            for low in range(0, len(texts), 256):
                part = texts.slice(low, 256)
                known = iter(distinct_grams(part.drop_null().to_pylist(), k))
                parts.append(pa.array([next(known) if valid else None for valid in part.is_valid().to_pylist()], pa.int32()))
            yield pa.concat_arrays(parts)

    return count(strip(F.lower(text)))


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """Those phrases, in their order, that occur in the text whatever the case."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))


def any_phrase_words(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether, for any phrase, each of its words occurs somewhere in the text."""
    low = F.lower(text)
    return F.exists(F.array(*[F.array(*[F.lit(w) for w in p.lower().split()]) for p in phrases]), lambda ws: F.forall(ws, lambda w: F.contains(low, w)))


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in the text."""
    return F.size(phrases_in(text, terms))


def relevant(text: Column, title: Column, primary: tuple[str, ...], places: tuple[str, ...]) -> Column:
    """A primary keyword by all its words, and a place; a keyword that names a place brings its own."""
    whole = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(title, F.lit("")))
    own = tuple(p for p in primary if any(g in p.lower() for g in places))
    place = term_hits(whole, places) > 0
    if own:
        place = any_phrase_words(whole, own) | place
    return any_phrase_words(whole, primary) & place


#: Marks that words lose at their ends; other signs, as of currencies, stay.
MARKS = ".,!?\"':;()[]{}\u2026\u2014\u2013-/\\"


def clean_word(word: Column) -> Column:
    """Without MARKS at the ends."""
    return F.btrim(word, F.lit(MARKS))
