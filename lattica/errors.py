"""Errors with a stable code and reason."""

from __future__ import annotations

BIND = "invalid_query"
EXECUTION = "execution_failed"
CONSTRAINT = "constraint_failed"
CATALOG = "catalog_error"
CONFLICT = "conflict"


class EngineError(Exception):
    """``code`` names the kind of failure, ``reason`` the exact rule that was broken."""

    def __init__(self, code: str, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.code, self.reason, self.detail = code, reason, detail


#: Marks errors that expressions raise on purpose.
OVERFLOW_TAG = "lattica:numeric_overflow"
_CONDITIONS = {"DIVIDE_BY_ZERO": "division_by_zero", "ARITHMETIC_OVERFLOW": "numeric_overflow", "CAST_OVERFLOW": "numeric_overflow", "NUMERIC_VALUE_OUT_OF_RANGE": "numeric_overflow", OVERFLOW_TAG: "numeric_overflow"}


def translated(error: Exception) -> Exception:
    """Spark's run-time errors as ours, where they mean one of our reasons."""
    text = str(error)
    for condition, reason in _CONDITIONS.items():
        if condition in text:
            return EngineError(EXECUTION, reason, text.splitlines()[0][:200])
    return error
