"""Packets: evidence packed into a document of bounded size with its own identity, and the checks of a packet that comes back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import digest

NO_ID = "sha256:" + "0" * 64
#: Numbers of a session's use, each with a ceiling.
USES = ("maps", "lookups", "expansions", "returned_items", "exact_source_bytes", "serialized_response_bytes", "repository_reads", "repeated_repository_reads", "elapsed_ms")


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)


def settled(rest: Column) -> Column:
    """The length of a document that holds its own length in digits, given the length of the rest of it."""
    out = F.lit(None).cast("long")
    for d in range(10, 0, -1):
        whole = rest + d
        out = F.when(F.length(whole.cast("string")) == d, whole).otherwise(out)
    return out


def packet_json(purpose: Column, snapshot: Column, created: Column, requested: Column, reserved: Column, delivered: Column, omitted: Column, evidence: Column, packet_id: Column) -> Column:
    """A packet's canonical text: names in the order of their bytes, numbers as text, no blanks."""
    parts = (
        F.lit('{"accounting":{"accounting_version":"1.0.0","delivered_bytes":"'), delivered.cast("string"), F.lit('","omitted_items":"'), omitted.cast("string"), F.lit('","requested_bytes":"'), requested.cast("string"), F.lit('","reserved_bytes":"'), reserved.cast("string"),
        F.lit('"},"created_at":'), quoted(created), F.lit(',"observed_evidence":['), evidence, F.lit('],"packet_id":"'), packet_id, F.lit('","purpose":'), quoted(purpose), F.lit(',"schema_name":"context-packet","schema_version":"1.0.0","truncations":['),
        F.when(omitted > 0, '"evidence_budget"').otherwise(""), F.lit('],"workspace_snapshot":'), quoted(snapshot), F.lit("}"),
    )
    return F.concat(*parts)


def build(evidence: DataFrame, headers: DataFrame, key: str, requested: int, most_items: int) -> DataFrame:
    """(key, packet, items, omitted, delivered, status) of headers (key, purpose, snapshot, created).

    evidence (key, ord, record): JSON texts in their order. As many of the first most_items records as fit are taken;
    `budget_too_small` if not even an empty packet fits. A packet's lengths are added up, so it is written once.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    first = evidence.withColumn("_n", place).groupBy(key).agg(F.count("*").alias("all"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most_items, F.struct("_n", "record")))).alias("r"))
    rows = headers.join(first, key, "left").withColumns({"all": F.coalesce("all", F.lit(0)), "texts": F.coalesce(F.transform("r", lambda x: x["record"]), F.array().cast("array<string>"))})
    zero, empty = F.lit(0).cast("long"), F.lit("")
    head = (F.col("purpose"), F.col("snapshot"), F.col("created"), F.lit(requested))
    bare = lambda reserved, omitted: F.octet_length(packet_json(*head, reserved, empty, omitted, empty, F.lit(NO_ID))).cast("long")
    rows = rows.withColumn("reserved", settled(bare(zero, F.col("all"))))
    sums = F.aggregate("texts", F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x) + F.when(F.size(a) > 1, 1).otherwise(0))))
    rows = rows.withColumns({"sums": sums, "none": bare(F.col("reserved"), zero)})
    extra = lambda k: F.length((F.col("all") - k).cast("string")) - 1 + F.when(F.col("all") - k > 0, 17).otherwise(0)  # noqa: E731  digits of what is omitted, and the word for it
    fits = F.filter(F.sequence(F.lit(0), F.size("texts")), lambda k: settled(F.col("none") + extra(k) + F.element_at("sums", k + 1)) <= requested)
    rows = rows.withColumn("items", F.when(F.col("reserved") <= requested, F.array_max(fits)))
    omitted = F.col("all") - F.col("items")
    inner = F.array_join(F.slice("texts", F.lit(1), F.col("items")), ",")
    rows = rows.withColumn("delivered", settled(F.col("none") + extra(F.col("items")) + F.element_at("sums", F.col("items") + 1)))
    unsigned = packet_json(*head, F.col("reserved"), F.col("delivered"), omitted, inner, F.lit(NO_ID))
    packet = F.replace(unsigned, F.lit(NO_ID), digest("context-packet", unsigned))
    good = F.col("items").isNotNull()
    return rows.select(key, F.when(good, packet).alias("packet"), F.col("items").cast("long").alias("items"), F.when(good, omitted).alias("omitted"), F.when(good, F.col("delivered")).alias("delivered"), F.when(good, "built").otherwise("budget_too_small").alias("status"))


def intact(packet: Column) -> Column:
    """Whether a packet's identity and its account of itself are true."""
    number = lambda name: F.regexp_extract(packet, rf'"{name}":"(0|[1-9][0-9]{{0,17}})"', 1).try_cast("long")
    given = F.regexp_extract(packet, r'"packet_id":"(sha256:[0-9a-f]{64})"', 1)
    unsigned = F.regexp_replace(packet, r'"packet_id":"sha256:[0-9a-f]{64}"', f'"packet_id":"{NO_ID}"')
    size = F.octet_length(packet).cast("long")
    honest = (number("delivered_bytes") == size) & (number("reserved_bytes") <= size) & (size <= number("requested_bytes"))
    return F.coalesce((given != "") & (digest("context-packet", unsigned) == given) & honest, F.lit(False))


def validation(packet: Column, authorized: Column, snapshot: Column, evidence: Column) -> tuple[Column, Column]:
    """(status, checks): the first check that fails names the status; checks tell all that were made.

    snapshot: the current one, null if it is not known. evidence: whether it can still be had.
    """
    version = F.get_json_object(packet, "$.schema_version")
    compatible = F.coalesce((F.get_json_object(packet, "$.schema_name") == "context-packet") & (version == "1.0.0"), F.lit(False))
    whole = intact(packet)
    current = F.get_json_object(packet, "$.workspace_snapshot") == snapshot
    status = (
        F.when(~compatible, "incompatible")
        .when(~whole, "corrupt")
        .when(~authorized, "denied")
        .when(snapshot.isNull(), "partially_unavailable")
        .when(~current, "valid_stale")
        .when(evidence, "valid_current")
        .otherwise("partially_unavailable")
    )
    made = F.when(~compatible, "schema:failed").when(~whole, "schema:passed,integrity:failed").when(~authorized, "schema:passed,integrity:passed,authorization:failed")
    before = "schema:passed,integrity:passed,authorization:passed"
    made = made.when(snapshot.isNull(), f"{before},snapshot:unavailable").when(~current, f"{before},snapshot:failed,freshness:failed").when(evidence, f"{before},snapshot:passed,evidence:passed,freshness:passed").otherwise(f"{before},snapshot:passed,evidence:unavailable,freshness:unavailable")
    return status, made


def consumption(calls: DataFrame, key: str, order: str, ceilings: dict[str, int]) -> DataFrame:
    """calls (key, order, a column per use) with their state: a call that would pass a ceiling is answered `exhausted` and not counted.

    Later calls may fit again, so a session's calls are folded in order; they are as many as a session has.
    """
    uses = [u for u in USES if u in calls.columns]
    queue = calls.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(F.col(u).cast("long").alias(u) for u in uses)))).alias("q"))
    zero = F.struct(*(F.lit(0).cast("long").alias(u) for u in uses))
    kind = calls.schema[order].dataType.simpleString()
    inner = ",".join(f"{u}:bigint" for u in uses)
    start = F.struct(zero.alias("used"), F.array().cast(f"array<struct<{order}:{kind},fits:boolean,used:struct<{inner}>>>").alias("out"))

    def step(a, x):
        fits = F.lit(True)
        for u in uses:
            fits = fits & (a["used"][u] + x[u] <= ceilings[u])
        used = F.struct(*(F.when(fits, a["used"][u] + x[u]).otherwise(a["used"][u]).alias(u) for u in uses))
        return F.struct(used.alias("used"), F.concat(a["out"], F.array(F.struct(x[order].alias(order), fits.alias("fits"), used.alias("used")))).alias("out"))

    done = queue.select(key, F.explode(F.aggregate("q", start, step)["out"]).alias("o"))
    return done.select(key, F.col(f"o.{order}").alias(order), F.when(F.col("o.fits"), "complete").otherwise("exhausted").alias("state"), *(F.col(f"o.used.{u}").alias(u) for u in uses), *((F.lit(ceilings[u]) - F.col(f"o.used.{u}")).alias(f"remaining_{u}") for u in uses))


def reply_bytes(body: dict, spent: dict[str, int], ceilings: dict[str, int], most: int | None = None) -> tuple[dict, dict]:
    """(reply, what is spent now): a reply that holds its own size among its uses; a closed reply where a ceiling would be passed."""
    call = dict.fromkeys(USES, 0) | body.get("uses", {})
    for _ in range(8):
        total = {u: spent[u] + call[u] for u in USES}
        if any(total[u] > ceilings[u] for u in USES):
            return {"state": "exhausted", "reason": "cumulative_ceiling_exhausted", "spent": spent}, spent
        reply = body | {"uses": call, "spent": total, "remaining": {u: ceilings[u] - total[u] for u in USES}, "state": "complete"}
        size = len(json.dumps(reply, sort_keys=True, separators=(",", ":")).encode())
        if most is not None and size > most:
            return {"state": "exhausted", "reason": "call_response_ceiling_exhausted", "spent": spent}, spent
        if call["serialized_response_bytes"] == size:
            return reply, total
        call = call | {"serialized_response_bytes": size}
    raise RuntimeError("a reply's size does not settle")


def repeat_reads(reads: DataFrame, session: str, order: str, identity: list[str], most: int = 4096) -> DataFrame:
    """reads with `notice`: whether the session was given the same thing before. A session remembers its first `most` things."""
    first = reads.groupBy(session, *identity).agg(F.min(order).alias("_first"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy("_first"))).select(session, *identity, "_first", (F.col("_n") <= most).alias("_known"))
    return reads.join(kept, [session, *identity]).withColumn("notice", F.col("_known") & (F.col(order) > F.col("_first"))).drop("_first", "_known")


class Sessions:
    """Packets that a consumer's sessions hold in this process: opened, attached to, read and closed by their owner alone."""

    def __init__(self, most_sessions: int = 64, most_bytes: int = 16 << 20):
        self.most_sessions, self.most_bytes, self.held, self.next = most_sessions, most_bytes, {}, 0

    def open(self, consumer: str) -> str:
        if not consumer:
            raise ValueError("a session has an owner")
        if len(self.held) >= self.most_sessions:
            raise ValueError("too many sessions")
        self.next += 1
        name = f"session_{self.next:08d}"
        self.held[name] = (consumer, {})
        return name

    def _of(self, name: str, consumer: str) -> dict:
        owner, packets = self.held.get(name, (None, None))
        if packets is None or owner != consumer:  # one answer for both, so a name tells nothing
            raise KeyError("no such session")
        return packets

    def attach(self, name: str, consumer: str, packet_id: str, packet: str) -> None:
        packets = self._of(name, consumer)
        if packet_id in packets:
            raise ValueError("attached already")
        if sum(len(p.encode()) for p in packets.values()) + len(packet.encode()) > self.most_bytes:
            raise ValueError("too many bytes")
        packets[packet_id] = packet

    def resolve(self, name: str, consumer: str, packet_id: str) -> str:
        return self._of(name, consumer)[packet_id]

    def close(self, name: str, consumer: str) -> int:
        packets = self._of(name, consumer)
        del self.held[name]
        return len(packets)
