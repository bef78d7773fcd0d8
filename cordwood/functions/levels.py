"""Severity names. Collection is lenient, the event contract is strict.

All helpers take and give SQL text.
"""

from __future__ import annotations

from cordwood.functions.text import utrim
from cordwood.schemas import LEVELS

_NAMES = ", ".join(f"'{level}'" for level in LEVELS)


def strict_level(level: str) -> str:
    """Trimmed lower-case level with ``warning`` written as ``warn``; other names pass."""
    folded = f"lower({utrim(level)})"
    return f"""CASE WHEN {level} IN ({_NAMES}) THEN {level}
 WHEN {folded} = 'warning' THEN 'warn' ELSE {folded} END"""


def is_level(level: str) -> str:
    return f"coalesce({strict_level(level)} IN ({_NAMES}), false)"


def lenient_level(level: str) -> str:
    """Like :func:`strict_level`, but a missing or unknown name becomes ``info``."""
    return f"if({is_level(level)}, {strict_level(level)}, 'info')"
