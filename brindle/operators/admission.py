"""Admission of a repository: inventory, execution surfaces, analyzer coverage, assessment, and the decision of a policy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import surfaces
from brindle.functions.text import content_hash, digest, is_json

# Bounds of an inventory and its outputs.
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES, PREFIX_BYTES, MOST_OUTPUT, MOST_FINDINGS, MOST_HASHES = 10_000, 536_870_912, 16_777_216, 4096, 4_194_304, 1000, 256

# What a text file's ending says: class, platform, analysis it needs, and what was not done with it.
TEXT_KINDS = [
    ("ps1 psd1 psm1", "script", "windows", "windows.powershell.static", "content_not_executed"),
    ("bat cmd", "script", "windows", "windows.batch.static", "content_not_executed"),
    ("reg", "configuration", "windows", "windows.persistence.static", "content_not_executed"),
    ("sln csproj vcxproj props targets", "configuration", "windows", "windows.build.execution-surface", "configuration_not_evaluated"),
    ("sh bash zsh fish", "script", "cross_platform", "script.static", "content_not_executed"),
    ("json jsonc toml yaml yml xml ini conf", "configuration", "cross_platform", None, "configuration_not_evaluated"),
    ("md markdown rst txt", "document", "cross_platform", None, "text_treated_as_untrusted_data"),
    ("rs go py js jsx ts tsx java kt kts cs scala ex exs clj cljs cljc hs lhs c h cc cpp cxx hpp hh hxx rb php swift", "source", "cross_platform", None, "source_not_executed"),
]
PE_ENDINGS = "exe dll sys scr com cpl ocx".split()
INCOMPLETE = ("oversized", "limit_reached", "read_failed", "changed_during_read", "profile_file_limit", "snapshot_mismatch")
EFFECTS = {"block": 4, "manual_review": 3, "require_analysis": 2, "allow_isolated_eligibility": 1}
CATEGORIES = "execution_surface lifecycle_hook code_download credential_path persistence privilege host_mount network_reference format_mismatch analyzer_detection unknown".split()
SEVERITIES = "informational low medium high critical".split()
CONFIDENCES = "confirmed high medium low unknown".split()
SHA = r"^sha256:[0-9a-f]{64}$"


def _kind(form: str, kind: str, platform: str, needs: str | None, *limits: str) -> Column:
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.struct(F.lit(form).alias("format"), strings([kind]).alias("classes"), strings([platform]).alias("platforms"), strings([needs] if needs else []).alias("requirements"), strings(limits).alias("limitations"))


def starts(data: Column, hexed: str) -> Column:
    return F.substring(data, 1, len(hexed) // 2) == F.unhex(F.lit(hexed))


def classify(files: DataFrame) -> DataFrame:
    """(path, content_hash, size, format, classes, platforms, classification, requirements, limitations) of (path, content).

    Magic bytes first, then whether the first 4,096 bytes are text, then the file's ending; none of it runs or unpacks anything.
    """
    data, name = F.substring("content", 1, PREFIX_BYTES), F.element_at(F.split("path", "/"), -1)
    ending = F.coalesce(F.lower(F.when(name.rlike(r"[^/]\.[^./]+$"), F.element_at(F.split(name, r"\."), -1))), F.lit(""))
    shallow = ("bounded_magic_only", "deep_format_parsing_not_performed")
    archive = starts(data, "504B0304") | starts(data, "1F8B") | starts(data, "377ABCAF271C") | starts(data, "526172211A07") | (F.substring(data, 258, 5) == F.lit(b"ustar"))
    binary = F.contains(data, F.lit(b"\0")) | ~F.is_valid_utf8(data.cast("string"))
    out = (
        F.when(starts(data, "4D5A") & ending.isin("dll", "ocx"), _kind("pe_candidate", "library", "windows", "windows.pe.metadata", *shallow))
        .when(starts(data, "4D5A"), _kind("pe_candidate", "executable", "windows", "windows.pe.metadata", *shallow))
        .when((ending == "msi") & starts(data, "D0CF11E0A1B11AE1"), _kind("msi_candidate", "installer", "windows", "windows.msi.tables", *shallow))
        .when(archive, _kind("archive_candidate", "archive", "cross_platform", "archive.static", "archive_not_traversed", "bounded_magic_only"))
        .when(binary, _kind("binary", "unknown", "cross_platform", "binary.static", "binary_content_not_parsed"))
    )
    for endings, kind, platform, needs, limit in TEXT_KINDS:
        out = out.when(ending.isin(*endings.split()), _kind("text", kind, platform, needs, limit))
    out = out.when(F.octet_length("content") == 0, _kind("unknown", "unknown", "cross_platform", None, "empty_artifact")).otherwise(_kind("text", "unknown", "cross_platform", None, "unrecognized_text_artifact"))
    rows = files.select("path", content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size"), out.alias("k"), ending.isin(*PE_ENDINGS).alias("pe"))
    disagree = F.col("pe") != (F.col("k.format") == "pe_candidate")
    limits = F.array_sort(F.array_distinct(F.when(disagree, F.array_append("k.limitations", F.lit("extension_magic_disagreement"))).otherwise(F.col("k.limitations"))))
    return rows.select("path", "content_hash", "size", "k.format", "k.classes", "k.platforms", F.when(F.col("k.format") == "unknown", "unknown").otherwise("observed").alias("classification"), "k.requirements", limits.alias("limitations"))


def inventory(files: DataFrame, most_files: int | None = MOST_FILES, most_bytes: int = MOST_BYTES, most_file_bytes: int = MOST_FILE_BYTES, most_output: int = MOST_OUTPUT) -> tuple[DataFrame, DataFrame]:
    """(artifacts, exclusions) in path order: files up to the first that breaks a bound, without those that are too large.

    Sizes alone are looked at for the bounds; at most most_files and one of them meet in a window. Without most_files there
    is no bound of any kind: all files are artifacts, in no order, and none meet.
    """
    if most_files is None:
        return classify(files), files.select(F.lit("").alias("reason"), F.lit(0).cast("long").alias("files")).limit(0)
    sizes = files.select("path", F.octet_length("content").cast("long").alias("size"))
    total = sizes.agg(F.count("*").alias("all"))
    first = sizes.orderBy("path").limit(most_files + 1)
    order = Window.orderBy("path")
    before = F.coalesce(F.sum(F.when(F.col("size") <= most_file_bytes, F.col("size"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = first.withColumns({"n": F.row_number().over(order), "before": before})
    stops = run.filter((F.col("n") > most_files) | (F.col("before") + F.col("size") > most_bytes)).agg(F.min("n").alias("stop"))
    seen = run.crossJoin(F.broadcast(stops)).filter("stop is null or n < stop")
    kept = seen.filter(F.col("size") <= most_file_bytes).select("path")
    artifacts = classify(files.join(F.broadcast(kept), "path", "left_semi"))
    # what does not fit the output goes from the end
    used = F.sum(F.octet_length(F.to_json(F.struct(*artifacts.columns))).cast("long") + 1).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    sized = artifacts.withColumn("_used", used)
    fits = sized.filter(F.col("_used") <= most_output).drop("_used")
    counts = seen.agg(F.count("*").alias("seen"), F.count_if(F.col("size") > most_file_bytes).alias("large")).crossJoin(total).crossJoin(sized.agg(F.count_if(F.col("_used") > most_output).alias("over")))
    reasons = F.array(F.struct(F.lit("limit_reached").alias("reason"), (F.col("all") - F.col("seen") + F.col("over")).alias("files")), F.struct(F.lit("profile_file_limit").alias("reason"), F.col("large").alias("files")))
    return fits, counts.select(F.explode(F.filter(reasons, lambda r: r["files"] > 0)).alias("r")).select("r.reason", "r.files")


def surface_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, hashed, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
            name = path.replace("\\", "/").rsplit("/", 1)[-1]
            try:
                spans = surfaces.lifecycle_spans(content) if name == "package.json" else surfaces.privilege_spans(content)
                rows += [(path, hashed, *span, None) for span in spans]
            except surfaces.Unreadable as reason:
                rows.append((path, hashed, None, None, None, None, None, str(reason)))
        columns = list(zip(*rows)) or [()] * 8
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "content_hash", "start", "end", "rule", "category", "severity", "reason"])


def execution_surfaces(files: DataFrame, snapshot: str, most: int = MOST_FINDINGS) -> tuple[DataFrame, DataFrame]:
    """(findings, exclusions): what manifests would run, as evidence and finding rows; why a manifest could not be told."""
    name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    manifests = files.filter(name.isin("package.json", *surfaces.COMPOSE)).select("path", content_hash(F.col("content")).alias("content_hash"), "content")
    found = manifests.mapInArrow(surface_task, "path string, content_hash string, start long, end long, rule string, category string, severity string, reason string")
    hits = found.filter("reason is null")
    first = hits.orderBy("path", "start", "rule").limit(most)
    evidence = digest("evidence", F.col("content_hash"), F.col("end").cast("string"), F.col("path"), F.lit(snapshot), F.col("start").cast("string"))
    rows = first.withColumn("evidence_id", evidence)
    finding = digest("security-finding", F.col("content_hash"), F.col("category"), F.col("evidence_id"), F.col("rule"), F.lit(snapshot))
    findings = rows.select(finding.alias("finding_id"), "evidence_id", "path", "content_hash", "start", "end", F.lit("observed").alias("classification"), "category", "severity", F.lit("confirmed").alias("confidence"), F.col("rule").alias("method"), F.lit("untrusted_workspace_content").alias("trust"))
    cut = hits.groupBy("path").agg(F.count("*").alias("n")).join(findings.groupBy("path").agg(F.count("*").alias("k")), "path", "left").filter("k is null or k < n").agg(F.min("path").alias("path")).filter("path is not null").select("path", F.lit("finding_limit").alias("reason"))
    return findings, found.filter("reason is not null").select("path", "reason").unionByName(cut)


def coverage(artifacts: DataFrame, most_hashes: int = MOST_HASHES) -> DataFrame:
    """(capability, hashes, state, state_reason, requirement_id): what analysis the artifacts need; more hashes raise.

    Distinct pairs are counted before any hash is gathered.
    """
    pairs = artifacts.select(F.explode("requirements").alias("capability"), "content_hash").distinct()
    sizes = pairs.groupBy("capability").agg(F.count("*").alias("n"))
    checked = pairs.join(sizes, "capability").withColumn("content_hash", F.when(F.col("n") <= most_hashes, F.col("content_hash")).otherwise(F.raise_error(F.concat(F.lit("too many artifacts need "), F.col("capability"))).cast("string")))
    grouped = checked.groupBy("capability").agg(F.array_sort(F.collect_set("content_hash")).alias("hashes"))
    return grouped.withColumns({"state": F.lit("unavailable"), "state_reason": F.lit("analyzer-execution-not-authorized"), "requirement_id": F.concat(F.lit("req_"), F.substring(digest("analyzer-requirement", F.col("capability"), F.array_join("hashes", ",")), 8, 32))})


def valid_timestamp(t: Column) -> Column:
    """A UTC time stamp with or without up to nine digits of a second, of a day that exists."""
    shaped = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?Z$")
    return F.coalesce(shaped & ~t.startswith("0000") & F.substring(t, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def time_key(t: Column) -> Column:
    """A text that orders like the time: fractions are filled up to nine digits."""
    whole, part = F.substring(t, 1, 19), F.regexp_extract(t, r"\.([0-9]+)Z$", 1)
    return F.concat(whole, F.lit("."), F.rpad(part, 9, F.lit("0")))


def applied(covered: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """covered with requirements completed by results; results (requirement_id, capability, hashes, ruleset, analyzer, completed_at, fresh_until).

    A result counts if it is of an open requirement with the same capability and hashes, was done, and is still fresh.
    """
    at = time_key(F.lit(now))
    fit = valid_timestamp(F.col("completed_at")) & valid_timestamp(F.col("fresh_until")) & (time_key(F.col("completed_at")) <= at) & (at < time_key(F.col("fresh_until"))) & F.col("ruleset").rlike(SHA) & F.col("analyzer").rlike(SHA)
    good = results.filter(fit).select("requirement_id", F.col("capability").alias("_capability"), F.col("hashes").alias("_hashes"), "analyzer", "ruleset", "completed_at", "fresh_until")
    joined = covered.join(good, "requirement_id", "left")
    ok = F.coalesce((F.col("state") == "unavailable") & (F.col("capability") == F.col("_capability")) & (F.col("hashes") == F.col("_hashes")), F.lit(False))
    when = lambda c: F.when(ok, F.col(c)).alias(c)
    return joined.select("requirement_id", "capability", "hashes", F.when(ok, "completed").otherwise(F.col("state")).alias("state"), F.when(ok, "normalized-analyzer-result-current").otherwise(F.col("state_reason")).alias("state_reason"), when("analyzer"), when("ruleset"), when("completed_at"), when("fresh_until"))


def derived_findings(found: DataFrame, snapshot: str, analyzer: str, ruleset: str) -> DataFrame:
    """Findings of an analyzer (content_hash, category, severity, confidence, method): marked as derived, unknown words refused."""
    known = F.col("category").isin(*CATEGORIES) & F.col("severity").isin(*SEVERITIES) & F.col("confidence").isin(*CONFIDENCES) & F.col("content_hash").rlike(SHA)
    identity = digest("security-finding", F.lit(analyzer), F.col("content_hash"), F.col("category"), F.col("method"), F.lit(ruleset), F.lit(snapshot))
    return found.filter(known).select(identity.alias("finding_id"), "content_hash", F.lit("derived").alias("classification"), "category", "severity", "confidence", "method", F.lit("untrusted_derived_data").alias("trust"))


def assess(key: str, workspaces: DataFrame, findings: DataFrame, exclusions: DataFrame, requirements: DataFrame) -> DataFrame:
    """(key, findings, completeness, unknowns, exclusions) of each workspace.

    workspaces (key, inventory_complete); findings (key, finding_id); exclusions (key, origin, reason), origin `inventory`
    or `execution-surface`; requirements (key, mandatory, state). Counts are taken before the join; findings may repeat.
    """
    n = findings.groupBy(key).agg(F.count_distinct("finding_id").alias("findings"))
    left = exclusions.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(":", "origin", "reason"))).alias("exclusions"), F.bool_or(F.col("origin") == "execution-surface").alias("surfaces"))
    open_ = requirements.groupBy(key).agg(F.bool_or(F.col("mandatory") & (F.col("state") != "completed")).alias("open"))
    joined = workspaces.join(n, key, "left").join(left, key, "left").join(open_, key, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    unknowns = F.array_sort(F.array_compact(F.array(F.when(~F.col("inventory_complete"), "inventory-incomplete"), F.when(flag(F.col("surfaces")), "execution-surface-observations-incomplete"), F.when(flag(F.col("open")), "mandatory-analysis-incomplete"))))
    return joined.select(key, F.coalesce("findings", F.lit(0)).alias("findings"), F.when(F.size(unknowns) == 0, "complete").otherwise("partial").alias("completeness"), F.array_join(unknowns, ",").alias("unknowns"), F.coalesce(F.array_join("exclusions", ","), F.lit("")).alias("exclusions"))


FIELDS = ("finding_category", "finding_severity", "finding_classification", "coverage_state", "assessment_completeness")
RULE = "rule_id string, priority long, effect string, match_field string, match_values array<string>, profile string"


def checked_policy(rules: list[tuple]) -> list[tuple]:
    """The rules in order, or ValueError: up to 256, by strictly rising (priority, id), known fields and effects, sorted values."""
    ids = [r[0] for r in rules]
    keys = [(r[1], r[0]) for r in rules]
    if not 1 <= len(rules) <= 256 or keys != sorted(set(keys)) or len(set(ids)) != len(ids):
        raise ValueError("rules are not in strict order")
    for rule_id, _, effect, field, values, profile in rules:
        if effect not in EFFECTS or field not in FIELDS or not 1 <= len(values) <= 16 or values != sorted(set(values)) or (effect == "allow_isolated_eligibility") != (profile is not None):
            raise ValueError(f"malformed rule {rule_id}")
    return rules


def decide(key: str, facts: DataFrame, assessments: DataFrame, missing: DataFrame, rules: list[tuple]) -> DataFrame:
    """(key, decision, matched, missing, profile) of a policy over many assessments.

    facts (key, field, value): what rules may match; assessments (key, completeness, unknowns as text); missing (key,
    capability): mandatory analyses that are not done. The strongest matched effect decides; what is incomplete can be no
    better than incomplete; eligibility needs exactly one profile.
    """
    spark = facts.sparkSession
    table = spark.createDataFrame(checked_policy(rules), RULE).select("rule_id", "priority", "profile", F.create_map(*(F.lit(x) for p in EFFECTS.items() for x in p))[F.col("effect")].alias("rank"), F.col("match_field").alias("field"), F.explode("match_values").alias("value"))
    every = facts.select(key, "field", "value").unionByName(assessments.select(key, F.lit("assessment_completeness").alias("field"), F.col("completeness").alias("value"))).distinct()
    hits = every.join(F.broadcast(table), ["field", "value"]).select(key, "rule_id", "priority", "rank", "profile").distinct()
    matched = hits.groupBy(key).agg(F.max("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("priority", "rule_id"))).alias("m"), F.array_sort(F.collect_set(F.when(F.col("rank") == 1, F.col("profile")))).alias("profiles"))
    gone = missing.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("capability")), ",").alias("missing"))
    joined = assessments.join(matched, key, "left").join(gone, key, "left")
    rank = F.coalesce("rank", F.lit(0))
    complete = (F.col("completeness") == "complete") & (F.col("unknowns") == "") & F.col("missing").isNull()
    eligible = (rank == 1) & (F.size("profiles") == 1)
    decision = F.when(rank == 4, "blocked").when(rank == 3, "manual_review_required").when((rank == 2) | ~complete, "analysis_incomplete").when(eligible, "isolated_execution_eligible").otherwise("manual_review_required")
    return joined.select(key, decision.alias("decision"), F.coalesce(F.array_join(F.transform("m", lambda x: x["rule_id"]), ","), F.lit("")).alias("matched"), F.coalesce("missing", F.lit("")).alias("missing"), F.when(decision == "isolated_execution_eligible", F.element_at("profiles", 1)).alias("profile"))


# external output


MANIFEST = "extension_id string, extension_version string, artifact_digest string, kind string, output_fields array<string>, capabilities array<string>, max_output_bytes long"
OUTPUT = "struct<schema_name:string,schema_version:string,extension_id:string,extension_version:string,artifact_digest:string,kind:string,claims_exact_source_authority:boolean,output_fields:array<string>,payload:string>"


def gate(outputs: DataFrame, manifests: DataFrame, pinned: DataFrame) -> DataFrame:
    """outputs (extension_id, bytes) with verdict and reason: the first check that fails quarantines.

    manifests: MANIFEST; pinned: column artifact_digest. Only a pinned extension that asks for no capability may submit.
    """
    pins = pinned.select("artifact_digest", F.lit(True).alias("pinned")).distinct()
    known = manifests.join(pins, "artifact_digest", "left")
    m = lambda c: F.col(f"m.{c}")
    joined = outputs.join(known.select("extension_id", F.struct(*known.columns).alias("m")), "extension_id", "left").withColumn("o", F.from_json(F.col("bytes").cast("string"), OUTPUT))
    o = lambda c: F.col(f"o.{c}")
    same = F.lit(True)
    for c in ("extension_id", "extension_version", "artifact_digest", "kind"):
        same = same & (o(c) == m(c))
    fields = (F.size(F.array_distinct(o("output_fields"))) == F.size(o("output_fields"))) & (F.size(F.array_except(o("output_fields"), m("output_fields"))) == 0)
    agrees = same & (o("schema_name") == "extension-output") & (o("schema_version") == "1.0.0") & ~o("claims_exact_source_authority") & fields
    whole = is_json(F.col("bytes").cast("string")) & o("schema_name").isNotNull() & o("output_fields").isNotNull() & o("claims_exact_source_authority").isNotNull()
    reason = (
        F.when(~F.coalesce(m("pinned"), F.lit(False)) | (F.size(m("capabilities")) > 0), "extension_not_authorized")
        .when(F.octet_length("bytes") > m("max_output_bytes"), "output_limit_exceeded")
        .when(~F.coalesce(whole, F.lit(False)), "invalid_output_contract")
        .when(~F.coalesce(agrees, F.lit(False)), "output_identity_or_authority_mismatch")
    )
    return joined.select("extension_id", "bytes", F.when(reason.isNull(), "accepted").otherwise("quarantined").alias("verdict"), reason.alias("reason"))


VENDOR = "struct<path:string,rules:array<struct<identifier:string,namespace:string,tags:array<string>,strings:array<struct<identifier:string,offset:bigint,match:string>>>>>"
NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,127}$"
MOST_INPUT, MOST_RULES, MOST_PARTS, MOST_RANGES = 131_072, 256, 32, 8192


def rule_matches(records: DataFrame, key: str) -> DataFrame:
    """records (key, raw, expected_path, size) with `error`, or observations: (namespace, rule, tags, ranges) sorted.

    raw is one line of JSON that a scanner wrote; ranges end within size bytes, sorted by place, name and length, and nothing
    may come twice.
    """
    body = F.substring("raw", 1, F.length("raw") - 1)
    text = body.cast("string")
    raw = F.col("raw")
    framed = (F.octet_length(raw) <= MOST_INPUT) & (F.octet_length(raw) > 1) & (F.right(raw.cast("string"), F.lit(1)) == "\n") & ~text.rlike(r"[\n\r]") & ~text.rlike("^(﻿|[ \t\x0c])|[ \t\x0c]$")
    parsed = records.withColumn("r", F.from_json(F.when(framed & F.is_valid_utf8(text), text), VENDOR))
    length = lambda s: F.regexp_extract(s["match"], r"^ \.\.\. ([1-9][0-9]{0,17}) more bytes$", 1)
    ranges = lambda rule: F.array_sort(F.transform(rule["strings"], lambda s: F.struct(s["offset"].alias("offset"), s["identifier"].alias("name"), length(s).try_cast("long").alias("length"))))

    def broken(rule: Column) -> Column:
        strings, tags = rule["strings"], rule["tags"]
        whole = rule["identifier"].isNotNull() & rule["namespace"].isNotNull() & tags.isNotNull() & strings.isNotNull()
        return (
            F.when(~whole, "json_contract")
            .when(~rule["identifier"].rlike(NAME) | ~rule["namespace"].rlike(NAME), "invalid_identifier")
            .when((F.size(tags) > MOST_PARTS) | (F.size(strings) > MOST_PARTS), "resource_limit")
            .when(F.size(strings) == 0, "json_contract")
            .when(F.exists(tags, lambda t: ~t.rlike(NAME)), "invalid_identifier")
            .when(F.size(F.array_distinct(tags)) < F.size(tags), "duplicate")
            .when(F.exists(strings, lambda s: ~F.coalesce(s["identifier"].rlike(r"^\$[A-Za-z_][A-Za-z0-9_]{0,127}$"), F.lit(False))), "invalid_identifier")
            .when(F.exists(strings, lambda s: length(s) == ""), "match_marker")
            .when(F.exists(strings, lambda s: F.coalesce((s["offset"] < 0) | (s["offset"] + length(s).try_cast("long") > F.col("size")), F.lit(True))), "range")
            .when(F.size(F.array_distinct(ranges(rule))) < F.size(strings), "duplicate")
        )

    errors = F.array_compact(F.transform("r.rules", broken))
    twice = F.size(F.array_distinct(F.transform("r.rules", lambda x: F.struct(x["namespace"], x["identifier"])))) < F.size("r.rules")
    total = F.aggregate("r.rules", F.lit(0), lambda a, x: a + F.size(x["strings"]))
    error = (
        F.when(~F.coalesce(framed, F.lit(False)), "framing")
        .when(~F.is_valid_utf8(text), "utf8")
        .when(~is_json(text) | F.col("r.path").isNull() | F.col("r.rules").isNull(), "json_contract")
        .when(F.col("r.path") != F.col("expected_path"), "path_mismatch")
        .when(F.size("r.rules") > MOST_RULES, "resource_limit")
        .when(F.size(errors) > 0, F.element_at(errors, 1))
        .when(total > MOST_RANGES, "resource_limit")
        .when(twice, "duplicate")
    )
    seen = F.array_sort(F.transform("r.rules", lambda x: F.struct(x["namespace"].alias("namespace"), x["identifier"].alias("rule"), F.array_sort(x["tags"]).alias("tags"), ranges(x).alias("ranges"))))
    return parsed.withColumn("error", error).select(key, "error", F.when(error.isNull(), seen).alias("observations"))


def manifest_problems(manifests: DataFrame, key: str) -> DataFrame:
    """(key, problem) of analyzer manifests: the first clause of the contract that does not hold, `valid` if all do.

    Columns: analyzer_id, version, publisher, executable, ruleset, capabilities, hosts, targets, network, determinism,
    result_schema, revoked, synthetic_only, repository_supplied, authority_added, manifest_id.
    """
    name = r"^[a-z][a-z0-9]*([._-][a-z0-9]+)*$"

    def listed(c: str, least: int, most: int, good) -> Column:
        a = F.col(c)
        return F.size(a).between(least, most) & (F.array_sort(F.array_distinct(a)) == a) & F.forall(a, good)

    fields = (
        ("analyzer_id", F.col("analyzer_id").rlike(name)),
        ("version", F.col("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")),
        ("publisher", F.octet_length("publisher").between(1, 1024)),
        ("digest", F.col("executable").rlike(SHA) & F.col("ruleset").rlike(SHA)),
        ("capabilities", listed("capabilities", 1, 64, lambda x: x.rlike(name))),
        ("hosts", listed("hosts", 1, 3, lambda x: x.isin("macos_arm64", "linux_x86_64", "windows_x86_64"))),
        ("targets", listed("targets", 1, 4, lambda x: x.isin("any", "windows", "macos", "linux"))),
        ("isolation", (F.col("network") == "none") & (F.col("determinism") == "deterministic") & (F.col("result_schema") == "analyzer-runner-result@1.0.0")),
        ("authority", ~F.col("revoked") & F.col("synthetic_only") & ~F.col("repository_supplied") & ~F.col("authority_added")),
        ("identity", F.col("manifest_id") == manifest_identity()),
    )
    problem = F.lit("valid")
    for label, holds in reversed(fields):
        problem = F.when(~F.coalesce(holds, F.lit(False)), label).otherwise(problem)
    return manifests.select(key, problem.alias("problem"))


def result_problems(results: DataFrame, key: str) -> DataFrame:
    """(key, problem) of analyzer results against their request and manifest, of one row: the first clause that does not hold.

    Columns: request_id, snapshot, manifest_id, analyzer_id, executable, ruleset, capabilities, completed_at, statuses (array of
    hash, status, bytes), findings, completeness, limitations, synthetic_only, safety_claimed, host_authorized, authority_added,
    result_id; of the request: asked_id, asked_snapshot, asked_capabilities, artifacts (array of hash, bytes), occurred_at,
    deadline_at; of the manifest: known_manifest, known_analyzer, known_executable, known_ruleset. Times are canonical texts, so
    their order is that of the texts.
    """
    expected = F.transform("artifacts", lambda a: F.struct(a["hash"].alias("hash"), F.lit("synthetic_accounted").alias("status"), a["bytes"].alias("bytes")))
    fields = (
        ("request", (F.col("request_id") == F.col("asked_id")) & (F.col("snapshot") == F.col("asked_snapshot"))),
        ("manifest", (F.col("manifest_id") == F.col("known_manifest")) & (F.col("analyzer_id") == F.col("known_analyzer")) & (F.col("executable") == F.col("known_executable")) & (F.col("ruleset") == F.col("known_ruleset"))),
        ("capabilities", F.col("capabilities") == F.col("asked_capabilities")),
        ("time", valid_timestamp(F.col("completed_at")) & F.col("completed_at").between(F.col("occurred_at"), F.col("deadline_at"))),
        ("statuses", F.col("statuses") == expected),
        ("findings", F.size("findings") == 0),
        ("completeness", (F.col("completeness") == "complete") & (F.col("limitations") == F.array(F.lit("synthetic-worker-no-analysis")))),
        ("authority", F.col("synthetic_only") & ~F.col("safety_claimed") & ~F.col("host_authorized") & ~F.col("authority_added")),
        ("identity", F.col("result_id") == result_identity()),
    )
    problem = F.lit("valid")
    for label, holds in reversed(fields):
        problem = F.when(~F.coalesce(holds, F.lit(False)), label).otherwise(problem)
    return results.select(key, problem.alias("problem"))


def result_identity() -> Column:
    return digest("analyzer-result", F.col("request_id"), F.col("snapshot"), F.col("manifest_id"), F.array_join("capabilities", ","), F.col("completed_at"), F.to_json("statuses"), F.col("completeness"))


def manifest_identity() -> Column:
    return digest("analyzer-manifest", F.col("analyzer_id"), F.array_join("capabilities", ","), F.col("executable"), F.array_join("hosts", ","), F.col("publisher"), F.col("ruleset"), F.array_join("targets", ","), F.col("version"))
