"""Text columns: nested annotation text, eligibility, byte decoding, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.fixed_values import JPEG_MAGIC, MIN_TEXT_TOKENS, PNG_MAGIC, RECEIPT_TERMS
from thresher.functions.hashing import as_column


def nested_text(paragraphs):
    """Lower-cased text of paragraphs > lines > words.

    A line gives its own text if it has any, otherwise the texts of its words.
    """
    def line_words(line):
        missing = line["text"].isNull() | (line["text"] == "")
        words = F.transform(line["words"], lambda w: F.coalesce(w["text"], F.lit("")))
        return F.when(missing, F.coalesce(words, F.array().cast("array<string>"))).otherwise(F.array(line["text"]))

    lines = F.flatten(F.transform(
        as_column(paragraphs), lambda p: F.coalesce(p["lines"], F.array().cast(
            "array<struct<text:string,words:array<struct<text:string>>>>"))))
    return F.lower(F.array_join(F.flatten(F.transform(lines, line_words)), " "))


def token_count(text):
    """Number of whitespace-separated tokens."""
    return F.regexp_count(as_column(text), F.lit(r"\S+"))


def contains_any(text, terms):
    """Whether any term occurs, also inside a longer word."""
    text = as_column(text)
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def text_eligible(text, min_tokens=MIN_TEXT_TOKENS, terms=RECEIPT_TERMS):
    """Free of the terms, which is the cheaper test, and long enough."""
    return ~contains_any(text, terms) & (token_count(text) >= min_tokens)


def clean_utf8(content):
    """Bytes to text: bad sequences become the replacement character, NULs go."""
    return F.translate(F.make_valid_utf8(as_column(content).cast("string")), "\0", "")


def sniff_type(content, width, height, channels):
    """`png`, `jpg`, `raw` (exactly width x height x channels bytes) or null."""
    content = as_column(content)
    expected = (as_column(width).cast("bigint") * as_column(height) * as_column(channels))
    return (
        F.when(F.hex(F.substring(content, 1, len(PNG_MAGIC) // 2)) == PNG_MAGIC, "png")
        .when(F.hex(F.substring(content, 1, len(JPEG_MAGIC) // 2)) == JPEG_MAGIC, "jpg")
        .when((F.octet_length(content) == expected) & as_column(channels).isin(1, 3, 4), "raw")
    )


def basename(path):
    return F.regexp_extract(as_column(path), r"([^/]*)$", 1)


def stem(path):
    """Basename without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path):
    """Last suffix with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))
