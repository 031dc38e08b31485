"""Text normal forms, tokens, n-grams and shape statistics as column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_dataset(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 become one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_candidate(text: Column) -> Column:
    """Lower case and trimmed, white space collapsed, then other runs become a space each (double spaces can stay)."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "^\\s+|\\s+$", ""), "\\s+", " ")
    return F.trim(F.regexp_replace(flat, "[^a-z0-9 ]+", " "))


def norm_surface(text: Column) -> Column:
    """Lower case, punctuation becomes spaces, white space collapsed; letters of all scripts stay."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " "))


def norm_chars(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.regexp_replace(F.lower(text), "\\s+", " ")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case; accents split words. Null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def _runs(items: Column, n: int, between: str) -> Column:
    """Runs of n items joined: the array is zipped with itself shifted, so the work is n times its length."""
    out = items
    for k in range(1, n):
        shifted = F.slice(items, k + 1, F.greatest(F.size(items), F.lit(1)))
        out = F.zip_with(out, shifted, lambda x, y: F.concat(x, F.lit(between), y))
    return F.filter(out, lambda x: x.isNotNull())


def word_ngrams(words: Column, n: int) -> Column:
    """Contiguous runs of n tokens joined by a space; none where there are fewer."""
    return _runs(words, n, " ")


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters, the whole text if it is shorter, none of empty text."""
    whole = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) >= n, _runs(F.split(text, ""), n, "")).otherwise(whole)


def occurrences(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def shape9(text: Column) -> dict[str, Column]:
    words = tokens(text)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    n = F.size(words)
    out = {"chars": F.length(text), "tokens": n, "mean_token": F.when(n > 0, letters / n).otherwise(F.lit(0.0)), "marks": occurrences(text, ".,;:!?")}
    return out | {name: occurrences(text, c) for name, c in (("commas", ","), ("semicolons", ";"), ("colons", ":"), ("dashes", "-"), ("parens", "()"))}


def shape4(text: Column) -> dict[str, Column]:
    """Characters, characters for each word, and shares of punctuation and digits."""
    chars = F.length(text)
    words = F.size(F.filter(F.split(F.trim(norm_chars(text)), " "), lambda w: w != ""))
    return {"chars": chars, "chars_per_word": chars / F.greatest(F.lit(1), words), "punct_share": occurrences(text, ".,;:!?") / F.greatest(F.lit(1), chars), "digit_share": occurrences(text, "0123456789") / F.greatest(F.lit(1), chars)}


def lexicon_hits(words: Column, lexicon: dict[str, list[str]]) -> dict[str, Column]:
    """For each class the number of tokens that are in its list."""
    within = lambda own: lambda w: w.isin(own)
    return {name: F.size(F.filter(words, within(own))) for name, own in lexicon.items()}


def view_text(*fields: Column) -> Column:
    """Fields joined by a space; null and empty ones are left out."""
    return F.array_join(F.filter(F.array(*fields), lambda x: x.isNotNull() & (x != "")), " ")


def lead_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), "[a-z]+", 0)


def canonical_hash(*columns: str) -> Column:
    """sha256 of compact JSON with sorted keys and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
