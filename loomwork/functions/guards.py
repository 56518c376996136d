"""Guards of user input, applied on the driver before a plan is built, and their column forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of search patterns (fixed values).
MOST_CHARS, MOST_REPEAT, MOST_ALTERNATIVES, MOST_NESTING = 1000, 30, 20, 5


#: A pattern's parts: escapes, character classes, groups' openings, quantifiers, single characters.
_PART = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:P?[<=!:#>]|[a-zA-Z-]+[:)]))?|\{\d*,?\d*\}|.", re.S)


def measure_regex(pattern: str) -> dict[str, int]:
    """Quantifiers, alternatives, depth and repeated groups that hold a repetition, in one walk over a pattern's parts; escapes and classes count for nothing."""
    out = {"repeats": 0, "alternatives": 0, "depth": 0, "nested": 0}
    groups, last = [False], False  # whether each open group, and the part before, holds a repetition
    for part in _PART.findall(pattern):
        if part[0] == "(" and not part.endswith(")"):
            groups.append(False)
            out["depth"] = max(out["depth"], len(groups) - 1)
        elif part == ")" and len(groups) > 1:
            last = groups.pop()
            groups[-1] |= last
            continue
        elif part in "*+?" or part[0] == "{" and len(part) > 2:
            out["repeats"] += 1
            out["nested"] += last
            groups[-1] = True
        elif part == "|":
            out["alternatives"] += 1
        last = False
    return out


def check_regex(pattern: str) -> str | None:
    """Why a pattern is refused, or None."""
    try:
        re.compile(pattern)
    except re.error:
        return "not a regular expression"
    found = measure_regex(pattern)
    reasons = {
        "too long": len(pattern.encode()) > MOST_CHARS, "nested quantifier": found["nested"] > 0, "nested too deeply": found["depth"] > MOST_NESTING,
        "too many alternatives": found["alternatives"] > MOST_ALTERNATIVES, "too many repetitions": found["repeats"] > MOST_REPEAT,
    }
    return next((why for why, hit in reasons.items() if hit), None)


def clamp(value: int, low: int, high: int) -> int:
    """The value inside the bounds; bounds the wrong way round are swapped."""
    low, high = min(low, high), max(low, high)
    return max(low, min(high, value))


def clean_query(text: str, most: int = 12000) -> str:
    """A query within the limit and without control characters, but for tabs and line ends."""
    return "".join(c for c in text[:most] if c in "\t\n\r" or ord(c) >= 0x20)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def safe_path(path: str, depth: int = 20) -> bool:
    """No absolute path, no way up, not too deep, no null byte."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    return bool(parts) and "\0" not in path and not path.startswith(("/", "~")) and ".." not in parts and len(parts) <= depth


def is_safe_path(path: Column, depth: int = 20) -> Column:
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    return (F.size(parts) > 0) & (F.size(parts) <= depth) & ~path.rlike(r"^[/~]") & ~F.array_contains(parts, "..") & ~F.contains(path, F.lit("\0"))


def safe_filename(name: Column) -> Column:
    """Up to 255 characters of a name behind its leading dots, separators as ``_``, null characters left out; ``unnamed`` if none are left."""
    kept = F.regexp_extract(F.translate(name, "/\\\0", "__"), r"(?s)^\.*(.{1,255})", 1)
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"^\.+$", ""), F.lit("")), F.lit("unnamed"))
