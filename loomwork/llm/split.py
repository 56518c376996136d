"""Problem 1: oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundary kinds, strongest first: a blank line, a line that starts at the
#: margin, any line end, a sentence end, white space.
_BOUNDARIES = (
    (8.0, re.compile(r"\n[ \t]*\r?\n(?=\S)|\n[ \t]*\r?\n")),
    (6.0, re.compile(r"\n(?=[^\s})\]])")),
    (4.0, re.compile(r"\n")),
    (2.0, re.compile(r"[.!?。！？][\"'»”)\]]*\s+")),
    (1.0, re.compile(r"\s+")),
)

#: Two code points that make one: CR and LF, a sign and the mark, selector, tone,
#: tag or joiner that follows it, what follows a joiner, two regional letters.
_JOINED = regex.compile(r"\r\n|.[\p{M}\u200d\ufe0e\ufe0f\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]|\u200d.|[\U0001f1e6-\U0001f1ff]{2}", regex.S)


def _best_cut(text: str, lo: int, hi: int, want: int) -> int:
    """The strongest boundary in [lo, hi], the nearer to ``want`` the better; ``want`` itself if there is none."""
    span = max(1, max(want - lo, hi - want))
    for weight, pattern in _BOUNDARIES:
        best, found = None, -1.0
        for m in pattern.finditer(text, lo, hi):
            p = m.end()
            if lo <= p <= hi and text[p - 1 : p + 1] != "\r\n":
                score = weight - 3.0 * abs(p - want) / span
                if best is None or score > found:
                    best, found = p, score
        if best is not None:
            return best
    for at in (*range(want, lo, -1), *range(want, hi)):  # not inside a letter or sign of several code points
        if not 0 < at < len(text) or not _JOINED.match(text, at - 1):
            return at
    return want


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Piece offsets: halve at the strongest boundary near the midpoint until a
    part fits into ``limit - overlap``, then let each piece reach back over the
    one before it, to the first boundary within ``overlap`` characters."""
    room = limit - overlap
    cuts, todo = [0], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            cuts.append(hi)
            continue
        mid, slack = (lo + hi) // 2, max(1, (hi - lo) // 6)
        at = _best_cut(text, mid - slack, mid + slack, mid)
        if not lo < at < hi:
            at = mid
        todo += [(at, hi), (lo, at)]
    pieces = []
    for k in range(len(cuts) - 1):
        start = cuts[k]
        if k and overlap:
            far = max(cuts[k] - overlap, 0)
            start = _best_cut(text, far, min(far + overlap // 4, cuts[k]), far)
        pieces.append((start, cuts[k + 1]))
    return pieces


def first_line(start: Column, end: Column, newlines: Column) -> Column:
    """The 1-based line a text starts on, from two unreliable line columns.

    Right and null-free lines are kept; swapped ones are turned round; one
    missing line is computed from the other; without any, the text starts on 1.
    """
    return (
        F.when(start.isNull() & end.isNull(), F.lit(1))
        .when(start.isNull(), F.greatest(end - newlines, F.lit(1)))
        .when(end.isNotNull() & (start > end) & (start - end == newlines), F.greatest(end, F.lit(1)))
        .otherwise(F.greatest(start, F.lit(1)))
        .cast("int")
    )


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "content",
    start_line_col: str | None = "start_line",
    end_line_col: str | None = "end_line",
    order_col: str | None = "indexed_at",
    limit: int = 8000,
    overlap: int = 800,
) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points.

    Result: ``id_col``, piece_no (from 0), n_pieces, char_start, char_end,
    content, start_line, end_line.  Pieces cover the text, none is longer than
    ``limit``, and each starts at most ``overlap`` characters before the end of
    the one before.

    Defined cases: null and empty texts and texts within the limit give no
    rows; repeated ids give the pieces of one row, the latest by ``order_col``,
    ties to the longest text, then the greatest; rows with a null id are told
    apart by their content; a text without any boundary is cut at exact sizes; missing or swapped lines
    are repaired (``first_line``); other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    null = F.lit(None).cast("int")
    text = F.col(text_col)
    big = df.where(F.length(text) > limit).select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        (F.col(start_line_col) if start_line_col else null).cast("int").alias("_s"),
        (F.col(end_line_col) if end_line_col else null).cast("int").alias("_e"),
        (F.col(order_col) if order_col else F.lit(0)).alias("_o"),
    )
    one = big.groupBy("_id", F.when(F.col("_id").isNull(), F.sha2("_text", 256)).alias("_null")).agg(
        F.max_by(F.struct("_text", "_s", "_e"), F.struct("_o", F.length("_text"), "_text")).alias("r")
    )
    newlines = F.length("r._text") - F.length(F.replace("r._text", F.lit("\n"), F.lit("")))
    ready = one.select("_id", F.col("r._text").alias("_text"), first_line(F.col("r._s"), F.col("r._e"), newlines).alias("_line"))
    kind = df.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, "piece_no", "n_pieces", "char_start", "char_end", "content", "start_line", "end_line"]
        for batch in batches:
            for key, body, line in zip(batch["_id"], batch["_text"], batch["_line"]):
                rows, at, seen = [], 0, int(line)
                spans = bisect_text(body, limit, overlap)
                for no, (a, b) in enumerate(spans):
                    seen += body.count("\n", at, a) if a >= at else -body.count("\n", a, at)
                    at = a
                    part = body[a:b]
                    last = seen + part.count("\n") - (part.endswith("\n") and b < len(body))
                    rows.append((key, no, len(spans), a, b, part, seen, last))
                yield pd.DataFrame(rows, columns=names)

    schema = (
        f"`{id_col}` {kind}, piece_no int, n_pieces int, char_start int, char_end int, "
        "content string, start_line int, end_line int"
    )
    return ready.mapInPandas(pieces, schema)
