"""Errors that a caller can act on: a closed set of codes, each with what to do about it."""

from __future__ import annotations

# Public codes and the action that helps.
CODES = {
    "invalid_input": "correct_input",
    "root_not_allowed": "choose_allowed_root",
    "symlink_escape": "choose_allowed_root",
    "path_not_found": "refresh_snapshot",
    "unsupported_artifact": "use_other_source",
    "unsupported_capability": "use_other_source",
    "unsupported_filesystem_object": "use_other_source",
    "policy_denied": "request_authorization",
    "stale_state": "refresh_snapshot",
    "evidence_unavailable": "refresh_snapshot",
    "integrity_failure": "rebuild",
    "corrupt_cache": "rebuild",
    "incompatible_cache": "rebuild",
    "budget_too_small": "raise_budget",
    "budget_exceeded": "reduce_scope",
    "resource_limit": "reduce_scope",
    "partial_result": "reduce_scope",
    "internal_failure": "report",
}


class EngineError(Exception):
    """One of the codes, with a message that holds no content."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(message or code)
        self.code = code

    def envelope(self) -> dict:
        return {"schema_name": "error", "schema_version": "1.0.0", "code": self.code, "message": str(self), "recovery_action": CODES[self.code]}
