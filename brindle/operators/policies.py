"""Local budget policies: compiled rules, effective budgets, and the policy store with previews and one step back."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.admission import time_key, valid_timestamp
from brindle.sources import store

#: The eight numbers of a budget, in the order of their names' bytes.
BUDGET = ("max_elapsed_ms", "max_evidence_items", "max_excerpt_bytes_per_item", "max_files", "max_matches", "max_memory_bytes", "max_traversal_depth", "requested")
MOST_RULES = 128


def compile_policy(revision: int, rules: list[dict], expires_at: str | None = None) -> dict:
    """A policy with its rules in order and its identity; ValueError for rules that are none.

    A rule: rule_id, purpose and capability (None: any), deny, and ceilings (a deny rule has none, another one at least one).
    """
    if not 1 <= len(rules) <= MOST_RULES:
        raise ValueError("a policy has between one and 128 rules")
    selectors, ids = set(), set()
    for rule in rules:
        ceilings = rule.get("ceilings") or {}
        if not re.fullmatch(r"[a-z][a-z0-9_-]{0,63}", rule["rule_id"]) or bool(rule["deny"]) == bool(ceilings) or any(k not in BUDGET or not isinstance(v, int) or v < 1 for k, v in ceilings.items()):
            raise ValueError(f"malformed rule {rule['rule_id']}")
        selector = (rule.get("purpose"), rule.get("capability"))
        if selector in selectors or rule["rule_id"] in ids:
            raise ValueError("two rules have one selector or one id")
        selectors.add(selector)
        ids.add(rule["rule_id"])
    key = lambda r: (r.get("purpose") is not None, r.get("purpose") or "", r.get("capability") is not None, r.get("capability") or "", r["rule_id"])
    body = {"expires_at": expires_at, "revision": revision, "rules": [{k: r.get(k) for k in ("capability", "ceilings", "deny", "purpose", "rule_id")} for r in sorted(rules, key=key)]}
    return body | {"policy_id": "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


def valid_policy(policy: dict) -> bool:
    """Whether a policy is what its own rules compile to."""
    try:
        return compile_policy(policy["revision"], policy["rules"], policy["expires_at"]) == policy
    except (KeyError, TypeError, ValueError):
        return False


def evaluate(requests: DataFrame, key: str, policy: dict | None, engine: dict, authorized: dict, now: Column) -> DataFrame:
    """(key, outcome, rule, reason, and the effective budget) of requests (key, purpose, capability, and a column per budget number).

    Of the rules that fit, one that denies comes first, then the most specific. The budget is the least of engine,
    authorization, caller and rule. An expired policy has no say.
    """
    spark = requests.sparkSession
    rules = policy["rules"] if policy else []
    columns = ", ".join(f"ceiling_{b} long" for b in BUDGET)
    table = spark.createDataFrame([(r["rule_id"], r["purpose"], r["capability"], r["deny"], *((r["ceilings"] or {}).get(b) for b in BUDGET)) for r in rules], f"rule string, rule_purpose string, rule_capability string, deny boolean, {columns}")
    expired = (time_key(now) >= time_key(F.lit(policy["expires_at"]))) if policy and policy["expires_at"] else F.lit(False)
    asked = requests.withColumn("_expired", expired)
    fits = (F.col("rule_purpose").isNull() | (F.col("rule_purpose") == F.col("purpose"))) & (F.col("rule_capability").isNull() | (F.col("rule_capability") == F.col("capability"))) & ~F.col("_expired")
    specific = F.col("rule_purpose").isNotNull().cast("int") + F.col("rule_capability").isNotNull().cast("int")
    best = Window.partitionBy(key).orderBy(~F.coalesce(F.col("deny"), F.lit(False)), F.desc(specific), F.asc_nulls_first("rule_purpose"), F.asc_nulls_first("rule_capability"), "rule")
    chosen = asked.join(F.broadcast(table), fits, "left").withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    deny = F.coalesce(F.col("deny"), F.lit(False))
    effective = {b: F.least(F.lit(engine[b]).cast("long"), F.lit(authorized[b]).cast("long"), F.col(b), F.col(f"ceiling_{b}")) for b in BUDGET}
    same = F.lit(True)
    for b, value in effective.items():
        same = same & (value == F.col(b))
    outcome = F.when(deny, "deny").when(same, "allow").otherwise("limit")
    reason = F.concat_ws(",", F.when(F.col("_expired"), "local_policy_expired"), F.when(deny, "local_policy_denied").when(same, "caller_budget_unchanged").otherwise("governing_budget_reduced"))
    return chosen.select(key, outcome.alias("outcome"), "rule", reason.alias("reason"), *(F.when(~deny, value).alias(f"effective_{b}") for b, value in effective.items()))


class PolicyStore:
    """The current policy and the one before it. Every change names the state it expects, and can be tried out first.

    States are numbered files that are never overwritten, so two writers that expect the same state cannot both succeed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _number(self) -> int:
        fs, at = store.file_system(self.spark, self.root)
        return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0) if fs.exists(at) else 0

    def _read(self, number: int) -> dict:
        return json.loads(store.read_bytes(self.spark, f"{self.root}/{number}")) if number else {"current": None, "previous": None}

    def state(self) -> dict:
        return self._read(self._number())

    def _change(self, expected: str | None, make, write: bool) -> dict:
        number = self._number()
        before = self._read(number)
        if (before["current"] or {}).get("policy_id") != expected:
            raise ValueError("stale state")
        after = make(before)
        receipt = {"before": (before["current"] or {}).get("policy_id"), "after": (after["current"] or {}).get("policy_id"), "written": write}
        if write:
            try:
                store.write_new(self.spark, f"{self.root}/{number + 1}", json.dumps(after, sort_keys=True).encode())
            except FileExistsError:
                raise ValueError("stale state") from None
        return receipt

    def apply(self, policy: dict, expected: str | None, preview: bool = False) -> dict:
        def make(before: dict) -> dict:
            if not valid_policy(policy):
                raise ValueError("malformed policy")
            if before["current"] and policy["revision"] <= before["current"]["revision"]:
                raise ValueError("stale state")
            return {"current": policy, "previous": before["current"]}

        return self._change(expected, make, not preview)

    def remove(self, expected: str, preview: bool = False) -> dict:
        return self._change(expected, lambda before: {"current": None, "previous": before["current"]}, not preview)

    def rollback(self, expected: str | None, preview: bool = False) -> dict:
        def make(before: dict) -> dict:
            if before["previous"] is None:
                raise ValueError("nothing to go back to")
            return {"current": before["previous"], "previous": before["current"]}

        return self._change(expected, make, not preview)


def valid_expiry(expires_at: Column) -> Column:
    return expires_at.isNull() | valid_timestamp(expires_at)
