"""Typed errors: every failure has a stable code."""

from __future__ import annotations


class EngineError(ValueError):
    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


def within(df, limit: int, code: str = "E_BUDGET"):
    """The rows, or an error if there are more than ``limit``: over-limit is never truncation.

    Looks at limit + 1 rows only.
    """
    if df.select(*df.columns[:1]).limit(limit + 1).count() > limit:
        raise EngineError(code, f"more than {limit} rows")
    return df
