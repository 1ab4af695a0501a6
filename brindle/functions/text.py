"""Byte-exact text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Fold A-Z alone: lower() would fold other letters and can change the number of bytes."""
    return F.translate(x, UPPER, LOWER)


#: Places that a column of offsets holds at most: the largest limit of matches, and one to tell that there are more.
MOST_PLACES = 10_001


def byte_offsets(text: Column, needle: str, most: int = MOST_PLACES) -> Column:
    """The first `most` byte offsets of the needle in valid UTF-8 text, overlapping ones too, in order.

    One split before each occurrence, which ends at the limit; offsets are running sums of the parts' bytes. So the text is
    read once, whatever the needle and however often it occurs.
    """
    before = "(?=\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    none = F.array().cast("array<int>")
    parts = F.split(text, before, most + 1)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    # every part begins with an occurrence, which may reach into the next one, but the first part, which may
    opens = lambda a: (a["at"] > 0) | F.startswith(text, F.lit(needle))
    step = lambda a, p: F.struct((a["at"] + F.octet_length(p)).alias("at"), F.when(opens(a), F.concat(a["out"], F.array(a["at"]))).otherwise(a["out"]).alias("out"))
    found = F.aggregate(parts, start, step, lambda a: a["out"])
    return F.when(F.contains(text, F.lit(needle)), F.slice(found, 1, most)).otherwise(none)


def excerpt_bounds(size: Column, start: Column, end: Column, cap: int) -> tuple[Column, Column]:
    """A window of cap bytes around a match, never shorter than the match."""
    left = F.greatest(start - F.floor(F.greatest(F.lit(cap) - (end - start), F.lit(0)) / 2), F.lit(0)).cast("long")
    return left, F.least(size, F.greatest(left + cap, end)).cast("long")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int"))


def terms(text: Column, most: int = 64) -> Column:
    """Sorted distinct lower-cased runs of [A-Za-z0-9_] of 1 to `most` characters."""
    words = F.split(ascii_lower(text), "[^a-z0-9_]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 1) & (F.length(w) <= most))))


def term_set(text: Column, most: int = 64) -> Column:
    """`terms` in the order of their first places."""
    words = F.split(ascii_lower(text), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 1) & (F.length(w) <= most)))


def base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x), "+/", "-_"), F.lit("="))


def content_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def digest(kind: str, *parts: Column) -> Column:
    """Domain-separated identity: SHA-256 over namespace, kind, version and parts, NUL between them."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\0", F.lit("brindle"), F.lit(kind), F.lit("1.0.0"), *parts).cast("binary"), 256))


# Words that say nothing in a task.
STOP_WORDS = "and are can could does find fix for from how into please should show that the this use using was what when where which with would".split()


def quoted(x: Column) -> Column:
    """Closed quotations of the three quote marks, without their marks; an unclosed quote swallows the rest."""
    found = F.regexp_extract_all(x, F.lit("'[^']*(?:'|\\z)|\"[^\"]*(?:\"|\\z)|`[^`]*(?:`|\\z)"), F.lit(0))
    closed = F.filter(found, lambda q: (F.length(q) >= 2) & (F.substring(q, 1, 1) == F.right(q, F.lit(1))))
    return F.transform(closed, lambda q: F.substr(q, F.lit(2), F.length(q) - 2))


def explicit(t: Column) -> Column:
    """Whether a text can be a signal: 1 to 256 printable ASCII characters."""
    return t.rlike(r"^[\x20-\x7e]{1,256}$")


def is_path(t: Column) -> Column:
    """A portable relative path: no root, no parent step, no empty step, and a slash or a short extension with a letter."""
    shape = t.contains("/") | t.rlike(r".\.(?=[A-Za-z0-9]{1,16}$)[0-9]*[A-Za-z][A-Za-z0-9]*$")
    return ~t.rlike(r"^/|(^|/)\.\.(/|$)|//") & shape


def is_identifier(t: Column) -> Column:
    """Snake, kebab, scoped and dunder names and those with a capital inside; separators at the edges don't count, and a
    hyphenated text with a part of digits, dots and capitals is a version or a range of lines."""
    named = t.rlike("^[A-Za-z_]") & t.rlike("[A-Za-z0-9]")
    core = F.regexp_replace(t, "^[_-]+|[_-]+$", "")
    version = t.contains("-") & t.rlike("(^|-)(?=[^-]*[0-9])[0-9.A-Z]+(-|$)")
    return named & ~version & (t.rlike("^__.*__$|::|[a-z][A-Z]") | core.rlike("[_-]"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value. A reader stops where a value ends, so what follows is looked at too."""
    closed = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit(',"y":1}')))
    return F.coalesce(F.try_variant_get(closed, "$.y", "int") == 1, F.lit(False))
