"""Text expressions: identifier fragments, tokens, estimates, cuts.  All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is not a letter, a digit or ``_`` separates raw tokens.
RAW_SEPARATOR = r"[^\p{L}\p{Nd}_]+"
#: Where an identifier falls apart: ``_``, lower to upper case, digit to
#: non-digit and back, and the last capital of a run before a lower-case letter.
FRAGMENT_BREAK = (
    r"_+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Nd})(?=[^\p{Nd}_])|(?<=[^\p{Nd}_])(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
)
#: What makes a search text look like code (fixed value).
CODE_LIKE = r"[a-z][A-Z]|[a-z]_[a-z]|[:.()\[\]{}]"


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, RAW_SEPARATOR), lambda x: x != "")


def fragments(raw: Column) -> Column:
    """Parts of an identifier, in order, as written."""
    return F.filter(F.split(raw, FRAGMENT_BREAK), lambda x: x != "")


def expand_token(raw: Column) -> Column:
    """The lower-case token and those of its lower-case fragments that differ from it.

    Tokens without capitals, digits and ``_`` have no fragments and take a short way.
    """
    low = F.lower(raw)
    parts = F.filter(F.transform(fragments(raw), lambda x: F.lower(x)), lambda x: x != low)
    return F.when(raw.rlike(r"[\p{Lu}\p{Nd}_]"), F.concat(F.array(low), parts)).otherwise(F.array(low))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Words times 4/3, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.size(words(text)) * 4 / 3), F.lit(0)).cast("bigint")


def truncate_runes(text: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` code points, and the suffix where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def word_overlap(query: str, text: Column) -> Column:
    """Occurrences in the text of the query's words, over its distinct words; null if the text has no words."""
    wanted = sorted({w.lower() for w in query.split()})
    have = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    hits = F.size(F.filter(have, lambda w: w.isin(wanted)))
    return F.when(F.size(have) > 0, hits / F.lit(max(1, len(wanted))))


def is_code_like(query: str) -> bool:
    return re.search(CODE_LIKE, query) is not None


def glob_regex(pattern: str) -> str:
    """An anchored expression for a file-name pattern; ``*`` and ``?`` do not cross ``/``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            out.append("[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]")
            i = j
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def fnv32a(text: Column) -> Column:
    """32-bit FNV-1a of the text's UTF-8 bytes, as bigint.

    Pieces of 64 characters are taken to hex one by one, so that the work grows
    with the length of the text and not with its square.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(.{1,64})"), F.lit(1))
    pairs = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(F.hex(F.encode(p, "UTF-8")), F.lit("(..)"), F.lit(1))))
    start = F.lit(2166136261).cast("bigint")
    step = lambda h, c: (h.bitwiseXOR(F.conv(c, 16, 10).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(text.isNotNull(), F.aggregate(pairs, start, step))
