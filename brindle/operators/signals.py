"""Task text to signals: quoted spans, paths, identifiers and lexical terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import STOP_WORDS, ascii_lower, explicit, is_identifier, is_path, quoted

#: Signals of a kind, tokens that are looked at, and bytes of a query.
MOST, MOST_TOKENS, MOST_BYTES = 16, 4096, 4096


def valid_query(text: Column) -> Column:
    """Whether a text can be a task: not empty, and no control character but newline, return and tab."""
    return (F.length(text) > 0) & ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def bounded_query(text: Column, most: int = MOST_BYTES) -> Column:
    """The first `most` bytes, cut back to a whole character."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.rtrim(cut, F.lit("�")))


def quotes(text: Column) -> Column:
    """The distinct quoted spans that can be signals, in order."""
    return F.array_distinct(F.filter(quoted(text), explicit))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _ of 1 to 64 characters, in order, repeats too."""
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9_]+"), lambda w: (F.length(w) >= 1) & (F.length(w) <= 64))


def lexical_terms(text: Column) -> Column:
    """Distinct words of three letters or more that are no stop words, longest first, then by text; if there is none, the
    text's first word of three letters."""
    long = F.filter(words(text), lambda w: F.length(w) >= 3)
    telling = F.array_distinct(F.filter(long, lambda w: ~w.isin(*STOP_WORDS)))
    keyed = F.array_sort(F.transform(telling, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.when(F.size(telling) > 0, F.transform(keyed, lambda x: x["w"])).otherwise(F.slice(long, 1, 1))


def task_signals(tasks: DataFrame, key: str, text: str, declared: DataFrame | None = None) -> DataFrame:
    """(key, kind, signal, ord): up to MOST paths and identifiers of each task, by first place.

    A dotted token stands for its member too. declared (name): names that the workspace declares distinctly; such a name
    counts as an identifier if it has a capital or is quoted, as a member, and as the receiver of a member.
    """
    tokens = F.filter(F.split(text, r"[^A-Za-z0-9_\-./:\\]+"), lambda t: F.length(F.regexp_replace(t, r"[.:]+$", "")).between(1, 256))
    normal = F.slice(F.transform(tokens, lambda t: F.replace(F.regexp_replace(t, r"[.:]+$", ""), F.lit("\\"), F.lit("/"))), 1, MOST_TOKENS)
    each = tasks.select(key, quotes(F.col(text)).alias("_quotes"), F.posexplode(normal).alias("pos", "token"))
    dotted = F.col("token").contains(".")
    member, receiver = F.regexp_extract("token", r"([^.]*)$", 1), F.regexp_extract("token", r"^(.*)\.[^.]*$", 1)
    roles = F.array(F.when(dotted, F.struct(F.lit(0).alias("role"), member.alias("name"))), F.when(dotted, F.struct(F.lit(1).alias("role"), receiver.alias("name"))), F.struct(F.lit(2).alias("role"), F.col("token").alias("name")))
    rows = each.select(key, "_quotes", "pos", F.explode(F.array_compact(roles)).alias("r")).select(key, "_quotes", "pos", "r.role", F.col("r.name").alias("signal"))
    if declared is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        rows = rows.join(declared.select(F.col("name").alias("signal"), F.lit(True).alias("known")).distinct(), "signal", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    code, name = is_identifier(F.col("signal")), F.col("signal")
    marked = name.rlike("^[A-Z]") | F.array_contains("_quotes", name)
    kind = (
        F.when((F.col("role") == 0) & (code | F.col("known")), "identifier")
        .when((F.col("role") == 1) & F.col("known"), "identifier")
        .when((F.col("role") == 2) & is_path(name), "path")
        .when((F.col("role") == 2) & (code | (F.col("known") & marked)), "identifier")
    )
    first = rows.withColumn("kind", kind).filter("kind is not null").groupBy(key, "kind", "signal").agg(F.min(F.struct("pos", "role")).alias("at"))
    ord_ = F.row_number().over(Window.partitionBy(key, "kind").orderBy("at")).cast("long")
    return first.withColumn("ord", ord_).filter(F.col("ord") <= MOST).select(key, "kind", "signal", "ord")
