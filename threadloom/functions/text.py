"""Text expressions built from Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.words import PUNCTUATION

# Blanks as Python's str.strip sees them, written so that every regex engine agrees.
BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
WORD_CHARS = r"[\p{L}\p{N}_]"


def strip_blanks(text: Column) -> Column:
    """Remove blanks (Unicode ones too) at both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def clean_text(text: Column) -> Column:
    """Strip both ends, then turn every newline, tab and carriage return into one blank."""
    return F.translate(strip_blanks(text), "\n\t\r", "   ")


def normalize_text(text: Column) -> Column:
    """Lower-case and turn each run of non-word characters into one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def remove_digits(text: Column) -> Column:
    """Delete decimal digits; the blanks around them stay."""
    return F.regexp_replace(text, r"\p{Nd}+", "")


def remove_punctuation(text: Column) -> Column:
    """Turn every ASCII punctuation character into a blank."""
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def vectorizer_tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CHARS + "{2,}"), F.lit(0))


def tidy_tokens(text: Column) -> Column:
    """Lower-cased words without punctuation; apostrophes inside a word stay."""
    pattern = rf"{WORD_CHARS}+(?:['’]{WORD_CHARS}+)*"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Split on runs of blanks."""
    return F.filter(F.split(text, rf"{BLANK}+"), lambda w: w != "")


def ngram_tokens(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by a blank."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")

    def runs(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    parts = [tokens if n == 1 else runs(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def drop_listed(tokens: Column, words: list[str]) -> Column:
    """Tokens that are not in a literal list (a hash lookup per token, no shuffle)."""
    return F.filter(tokens, lambda w: ~w.isin(words)) if words else tokens


def truncate_text(text: Column, length: int | None, mode: str = "char") -> Column:
    """First ``length`` units of a text, as characters, blank-separated words or vectorizer tokens."""
    if length is None:
        return text
    if mode == "char":
        return F.substring(text, 1, length)
    if mode == "whitespace":
        return F.array_join(F.slice(whitespace_tokens(text), 1, length), " ")
    if mode == "vectorizer":
        return F.array_join(F.slice(vectorizer_tokens(text), 1, length), " ")
    raise ValueError(f"unknown truncation mode {mode!r}")


def extract_label(answer: Column, prefix: str = "Topic: ", extra_prefixes: tuple[str, ...] = ("The topic is:",)) -> Column:
    """The label in a model answer: what follows ``prefix`` up to its next use, else the whole answer.

    ``extra_prefixes`` are tried when ``prefix`` does not occur; pass ``()`` for
    the strict form.
    """
    label = strip_blanks(answer)
    for mark in reversed((prefix, *extra_prefixes)):
        label = F.when(
            F.contains(answer, F.lit(mark)),
            strip_blanks(F.get(F.split(answer, "\\Q" + mark + "\\E"), F.lit(1))),
        ).otherwise(label)
    return label


def parse_ndjson(raw: Column) -> Column:
    """Join the text parts of a newline-delimited JSON answer; lines that are no JSON are skipped."""
    lines = F.split(raw, "\n")

    def part(line: Column) -> Column:
        return F.concat(
            F.coalesce(F.get_json_object(line, "$.message.content"), F.lit("")),
            F.coalesce(F.get_json_object(line, "$.response"), F.lit("")),
        )

    return F.array_join(F.transform(lines, part), "")


def parse_ndjson_messages(raw: Column) -> Column:
    """The chat messages inside a newline-delimited JSON answer, in order."""
    lines = F.filter(F.split(raw, "\n"), lambda l: F.get_json_object(l, "$.message").isNotNull())
    return F.transform(
        lines,
        lambda l: F.struct(
            F.get_json_object(l, "$.message.role").alias("role"),
            F.get_json_object(l, "$.message.content").alias("content"),
        ),
    )
