"""Log reduction: clean lines, classify them, order them by what they tell, and take what a byte budget holds.

A log is at most MOST_OFFERED bytes, so one log's lines may meet in one task; logs are spread by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words, endings, symbols and openings by which lines are classified, and the bounds of a request.
FAILURE_WORDS = "aborted aborting assertion cannot error errors exception exceptions expected fail failed failing fails failure failures fatal panic panicked traceback unresolved".split()
FAILURE_ENDINGS = "Error Exception Failure".split()
FAILURE_SYMBOLS = "●×✕✗✖"
SUCCESS_SYMBOLS = "✓✔√"
WARNING_WORDS = "deprecated deprecation warning warnings".split()
WARNING_ENDINGS = ["Warning"]
ZERO_WORDS = "0 no without zero".split()
COUNT_WORDS = "error errors failed failing failures passed passing pending problem problems skipped warning warnings".split()
VERDICT_OPENINGS = ["OK (", "FAILED (", "test result:", "Tests:", "Test Suites:", "Success: ", "FAIL\t", "Finished "]
MOST_OFFERED, MOST_CONTEXT, ANCHORS = 8 * 1024 * 1024, 8, 3

ESCAPE = "\x1b"
#: A control sequence, a string control that a bell or ESC \ ends on its line, another escape; else the escape character alone.
ESCAPES = rf"{ESCAPE}\[[0-?]*[ -/]*[@-~]|{ESCAPE}[\]PX^_][^\x07{ESCAPE}\n]*(?:\x07|{ESCAPE}\\)|{ESCAPE}(?![\[\]PX^_ -/])[0-~]|{ESCAPE}[ -/]+[0-~]|{ESCAPE}"
#: The first time stamp that begins within 160 bytes, over one character a byte.
STAMP = r"(?s)^.{0,159}?[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?Z "
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[A-Za-z0-9_./\\-]+"
EXTENSION = r"\.[a-z][a-z0-9]{0,4}"


def without_escapes(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(ESCAPE)), F.regexp_replace(line, ESCAPES, "")).otherwise(line)


def without_timestamp(line: Column) -> Column:
    """The text after a leading time stamp; places are counted in bytes."""
    latin = F.decode(line.cast("binary"), "ISO-8859-1")
    cut = F.decode(F.encode(F.regexp_replace(latin, STAMP, ""), "ISO-8859-1"), "UTF-8")
    return F.when(line.rlike("[0-9]T[0-9]{2}:[0-9]{2}:"), cut).otherwise(line)


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", "")


def has_word(line: Column, words: list[str], endings: list[str]) -> Column:
    """Whether a token holds one of the words, or a type name with one of the endings: in no flag, no file name, no zero count."""
    listed, ended = "|".join(words), "|".join(endings)
    tokens = F.regexp_extract_all(line, F.lit(f"({TOKEN})"), F.lit(1))
    none = F.array(F.lit(None).cast("string"))

    def counts(x: Column) -> Column:
        raw, before, after = x["raw"], x["before"], x["after"]
        bare = F.regexp_replace(raw, "^[.-]+|[.-]+$", "")
        zero = F.coalesce(F.lower(before).isin(ZERO_WORDS), F.lit(False)) | F.coalesce(after == "0", F.lit(False))
        file = bare.rlike(rf"[/\\]|^.+{EXTENSION}$")
        return ~zero & ~raw.rlike("^-+[A-Za-z]") & ~file & bare.rlike(rf"(?:^|[.-])(?i:{listed})(?:[.-]|$)|[a-z0-9](?:{ended})(?:[.-]|$)")

    # a token beside its neighbours: three arrays shifted against each other, each cut from the line once
    lined = F.arrays_zip(F.concat(tokens, none).alias("raw"), F.concat(none, tokens).alias("before"), F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), none, none).alias("after"))
    found = F.exists(F.filter(lined, lambda x: x["raw"].isNotNull()), counts)
    # most lines have none of these letters in a row and need no tokens
    return F.when(line.rlike(f"(?i:{listed})|{ended}"), found).otherwise(False)


def reports_success(line: Column) -> Column:
    t = trimmed(line)
    return t.rlike(f"^[{SUCCESS_SYMBOLS}]") | t.endswith(" ... ok") | t.startswith("PASSED ") | t.startswith("--- PASS") | (t.startswith("ok ") & ~t.contains("\t"))


def reports_failure(line: Column) -> Column:
    return line.rlike(rf"^E  |^[{SPACE}]*(?:not ok |left:|right:|[{FAILURE_SYMBOLS}])") | has_word(line, FAILURE_WORDS, FAILURE_ENDINGS)


def counted_result(line: Column) -> Column:
    """Whether a whole number is followed by a result word."""
    edge = f"[^A-Za-z0-9{SPACE}]*"
    return line.rlike(f"(?:^|[{SPACE}]){edge}[0-9]+{edge}[{SPACE}]+{edge}(?i:{'|'.join(COUNT_WORDS)}){edge}(?:[{SPACE}]|$)")


def reports_verdict(line: Column) -> Column:
    t = trimmed(line)
    opened = "|".join(f"\\Q{x}\\E" for x in VERDICT_OPENINGS)
    return (
        t.isin("OK", "PASS", "FAIL")
        | t.rlike(f"^(?:{opened})|^(?:# |ℹ )(?:tests|pass|fail|suites) ")
        | (t.startswith("Ran ") & t.contains(" test"))
        | (t.startswith("ok ") & t.contains("\t"))
        | t.contains("could not compile")
        | t.contains("no tests ran")
        | counted_result(t)
    )


def source_location(line: Column) -> Column:
    """Whether a line names a place in a file: file.ext:12, file.ext(12,5), or a Python frame."""
    frame = rf'^[{SPACE}]*File "(?:(?!", line ).)*", line [0-9]'
    return line.rlike(frame) | line.rlike(rf"[A-Za-z0-9_.-]{EXTENSION}(?::[0-9]|\([0-9]+,[0-9]+\))")


def line_signal(line: Column) -> Column:
    """quiet, warning, location or failure: what a clean line reports on its own."""
    message = without_timestamp(line)
    return (
        F.when(reports_success(message), "quiet")
        .when(reports_failure(message), "failure")
        .when(has_word(message, WARNING_WORDS, WARNING_ENDINGS), "warning")
        .when(source_location(message), "location")
        .otherwise("quiet")
    )


def line_verdict(line: Column) -> Column:
    """Whether a clean line reports a run's result."""
    return reports_verdict(without_timestamp(line))


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, line): split at LF, a CR before it dropped, no empty line after the last LF."""
    parts = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    ended = F.when(F.col(text).endswith("\n"), F.size(parts)).otherwise(F.size(parts) - 1)
    cut = F.transform(parts, lambda x, i: F.when((i < ended) & x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return rows.filter(F.col(text) != "").select(key, F.posexplode(cut).alias("idx", "line"))


def classified(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, raw, line, signal, verdict) of each line, escapes removed from line."""
    clean = lines(rows, key, text).withColumnRenamed("line", "raw").withColumn("line", without_escapes(F.col("raw")))
    return clean.withColumns({"signal": line_signal(F.col("line")), "verdict": line_verdict(F.col("line"))})


def ordered(judged: DataFrame, key: str, context: int) -> DataFrame:
    """judged with the place (stage, ord) at which each line is offered first; null for lines that never are.

    Stages: the last verdict; verdicts that report failures; the first failure; the last lines; the first failure's context;
    failures and locations that no earlier line repeats; their context; warnings and verdicts with context; the first lines.
    """
    whole, near = Window.partitionBy(key), Window.partitionBy(key).orderBy("idx").rowsBetween(-context, context)
    failure, idx = F.col("signal") == "failure", F.col("idx")
    evidence = F.col("signal").isin("failure", "location")
    copy = F.row_number().over(Window.partitionBy(key, "line", evidence).orderBy("idx"))
    marked = judged.withColumns(
        {
            "n": F.count("*").over(whole),
            "last_verdict": F.max(F.when(F.col("verdict"), idx)).over(whole),
            "first_failure": F.min(F.when(failure, idx)).over(whole),
            "fresh": evidence & (copy == 1),
        }
    )
    marked = marked.withColumns({"beside": F.max("fresh").over(near), "lesser": F.max((F.col("signal") == "warning") | F.col("verdict")).over(near)})
    late, early = -idx, idx
    stages = (
        (idx == F.col("last_verdict"), early),
        (F.col("verdict") & failure, late),
        (idx == F.col("first_failure"), early),
        (idx >= F.col("n") - ANCHORS, early),
        (F.abs(idx - F.col("first_failure")) <= context, early),
        (F.col("fresh"), late),
        (F.col("beside"), late),
        (F.col("lesser"), late),
        (idx < ANCHORS, early),
    )
    places = F.array(*(F.when(when, F.struct(F.lit(i + 1).alias("stage"), order.cast("long").alias("ord"))) for i, (when, order) in enumerate(stages)))
    return marked.withColumn("place", F.array_min(places)).drop("n", "last_verdict", "first_failure", "fresh", "beside", "lesser")


def reduce_logs(rows: DataFrame, key: str, text: str, budget: int, context: int) -> DataFrame:
    """One row per log: key, text (chosen lines in their order), byte and line counts, escape bytes removed, omissions, error.

    A line costs its bytes and one; one that does not fit is passed over, and later ones may fit.
    """
    if budget < 1 or not 0 <= context <= MOST_CONTEXT:
        raise ValueError("a reduction takes a budget of a byte or more and at most eight lines of context")
    within = F.octet_length(text) <= MOST_OFFERED
    placed = ordered(classified(rows.filter(within), key, text), key, context)
    cost = F.octet_length("line").cast("long") + 1
    entry = F.struct("place", F.col("idx"), cost.alias("cost"), "line", (F.octet_length("raw") - F.octet_length("line")).cast("long").alias("removed"))
    queue = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), entry))).alias("queue"), F.count("*").alias("offered_lines"))
    kept = F.struct("idx", "line", "removed")
    kind = placed.select(entry.alias("e")).select("e.idx", "e.line", "e.removed").select(F.array(kept).alias("a")).schema["a"].dataType.simpleString()
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(False).alias("missed"), F.array().cast(kind).alias("kept"))

    def offer(a, x):
        took = F.struct((a["left"] - x["cost"]).alias("left"), a["missed"].alias("missed"), F.concat(a["kept"], F.array(F.struct(x["idx"].alias("idx"), x["line"].alias("line"), x["removed"].alias("removed")))).alias("kept"))
        return F.when(x["cost"] <= a["left"], took).otherwise(F.struct(a["left"].alias("left"), F.lit(True).alias("missed"), a["kept"].alias("kept")))

    picked = queue.select(key, "offered_lines", F.aggregate("queue", start, offer).alias("s")).withColumn("kept", F.array_sort("s.kept"))
    joined = F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
    omitted = F.when(F.size("kept") < F.col("offered_lines"), "output_lines_omitted")
    missed = F.when(F.col("s.missed"), "output_returned_byte_limit_reached")
    done = picked.select(
        key,
        joined.alias("reduced"),
        "offered_lines",
        F.size("kept").cast("long").alias("returned_lines"),
        F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["removed"]).alias("escape_bytes_removed"),
        F.array_join(F.array_compact(F.array(omitted, missed)), ",").alias("omissions"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select(key, F.octet_length(text).cast("long").alias("offered_bytes"), F.when(~within, "invalid_payload").alias("error")).join(done, key, "left").select(
        key,
        F.coalesce("reduced", F.lit("")).alias("reduced"),
        "offered_bytes",
        F.octet_length(F.coalesce("reduced", F.lit(""))).cast("long").alias("returned_bytes"),
        zero("offered_lines").alias("offered_lines"),
        zero("returned_lines").alias("returned_lines"),
        zero("escape_bytes_removed").alias("escape_bytes_removed"),
        F.coalesce("omissions", F.lit("")).alias("omissions"),
        "error",
    )


def greedy(rows: DataFrame, key: str, order: list, cost: Column, item: str, budget: int) -> DataFrame:
    """(key, items, used, skipped): items taken in order while they fit; one that does not fit is skipped and later ones may."""
    queue = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, cost.cast("long").alias("cost"), F.col(item).alias("item")))).alias("queue"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("skipped"), F.array().cast("array<int>").alias("items"))
    took = lambda a, x: F.struct((a["used"] + x["cost"]).alias("used"), a["skipped"].alias("skipped"), F.concat(a["items"], F.array(x["item"])).alias("items"))
    step = lambda a, x: F.when(a["used"] + x["cost"] <= budget, took(a, x)).otherwise(F.struct(a["used"].alias("used"), F.lit(True).alias("skipped"), a["items"].alias("items")))
    return queue.select(key, F.aggregate("queue", start, step).alias("s")).select(key, F.array_sort("s.items").alias("items"), F.col("s.used").alias("used"), F.col("s.skipped").alias("skipped"))
