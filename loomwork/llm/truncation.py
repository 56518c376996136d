"""Problem 8: texts cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Characters that count as blank at the ends of a text (fixed values).
BLANKS = " \t\r\n\f\v\u00a0\u200b\u2028\u2029\u3000\ufeff"
#: Marks that only a machine puts after a cut (fixed values, as patterns).
CUT_MARK = re.compile(r"\s*(\[(more|\.\.\.|…|truncated|cut|snip)\]|\((more|truncated)\)|<truncated>|\[\+\d+ chars\])\s*$")
#: Dots after a text: a machine's mark or a pause the author meant.
DOTS = re.compile(r"\s*(\.{3,}|…)\s*$")
#: What may follow a text without making it longer: blanks and one mark.
ONLY_MARK = r"^[\s\u00a0\u200b\u2028\u2029\u3000\ufeff]*(\[(more|\.\.\.|…|truncated|cut|snip)\]|\((more|truncated)\)|<truncated>|\[\+\d+ chars\]|\.{3,}|…)?[\s\u00a0\u200b\u2028\u2029\u3000\ufeff]*$"
#: Ends of a whole sentence, also behind closing quotes or brackets, and an emoticon.
SENTENCE_END = re.compile(r"([.!?。！？…:;]|[.!?。！？]?[\"'”’»)\]*_`]+)$|(:-?[)(D]|;-?\))$")
#: The document types that hold program code (fixed values).
CODE_TYPES = ["go", "python", "javascript", "typescript", "php", "rust", "java", "c", "cpp", "css"]
#: Last lines that need no closing mark: bullets and numbers with a short
#: phrase, table rows, fences, headings, trailers such as ``Refs: X-1``, titles.
LOOSE_LINE = re.compile(
    r"^(\s*[-*+] (\[[ xX]\] )?\S+( \S+){0,4}|\s*\|.*\||\s*(`{3,}|~{3,}|-{3,}|={3,}).*|#{1,6} .*"
    r"|[A-Z][A-Za-z-]*: [A-Z]+-\d+|\(.*\)|.*:)$"
)
#: A commit's subject, which has no closing mark, as the only line of a text.
SUBJECT = re.compile(r"^[a-z]+(\([^)\n]*\))?!?:[ \u00a0][^\n]*$")
#: A subject with the body flattened behind it.
FLATTENED = re.compile(r"^[a-z]+(\([^)\n]*\))?!?: [^\n]*\S  [A-ZÀ-ÖØ-ÞЀ-Я]")
#: Starts of structured texts and ends of whole pages and code (fixed patterns).
JSON_START, HTML_START = re.compile(r"[\[{]\s*[\"{\[]"), re.compile(r"<(!doctype|html|\?xml)", re.I)
HTML_END = re.compile(r"</(html|body|rss|feed|svg)>\s*$", re.I)
CODE_END = re.compile(r"^\s*[})\]]+[;,]?$|^\s*(return|pass|raise|continue|break)\b[^(\[{]*$|[;}]$|\?>$")
LAST_WORD = re.compile(r"(\w+)$")
WORD, FINAL_WORD = re.compile(r"\w+"), re.compile(r"(\w+)[.!?](?=\s|[<\"]|$)")
#: Share of a word's occurrences that end sentences, from which dots after it may be a pause.
FINAL_SHARE = 0.02


def describe_end(text: str, kind: str | None) -> tuple[str, bool, bool, bool, bool, str] | None:
    """(shape, marked, dots, open, whole, last word) of a text, or None if it is blank.

    Brackets are counted over the whole text; its last line and last words are
    read from the last 400 characters.
    """
    body = text.rstrip(BLANKS)
    if not body:
        return None
    tail = body[-400:]
    end = tail[-60:]
    marked, dots = CUT_MARK.search(end) is not None, DOTS.search(end) is not None
    core = (CUT_MARK.sub("", tail) if marked else DOTS.sub("", tail) if dots else tail).rstrip(" ")
    end, line = core[-60:], core.rsplit("\n", 1)[-1]
    head = text[:200].lstrip(BLANKS)
    unclosed = any(body.count(a) > body.count(b) for a, b in ("{}", "()", "[]"))
    word = LAST_WORD.search(end)
    if kind in CODE_TYPES:
        shape = "code"
        last = body.rsplit("\n", 1)[-1]
        is_open = unclosed or not (text.rstrip(" \t").endswith("\n") or CODE_END.search(last))
    elif JSON_START.match(head):
        shape, is_open = "json", unclosed
    elif HTML_START.match(head):
        shape, is_open = "html", HTML_END.search(tail) is None
    else:
        # a fence is open if the number of its marks is odd
        shape, is_open = "title" if kind == "todo" else "prose", body.count("```") % 2 == 1
    if shape in ("code", "json", "html"):
        whole = not is_open
    else:
        subject = SUBJECT.match(body) and not FLATTENED.match(body)
        whole = bool(SENTENCE_END.search(end) or LOOSE_LINE.match(line) or subject or (end.endswith(("}", "]")) and not unclosed))
    return shape, marked, dots, is_open, whole, word[1].lower() if word else ""


def core_text(text: str) -> str:
    """The text without a mark of omission and blanks at its end."""
    body = text.rstrip(BLANKS)
    head, tail = body[:-400], body[-400:]
    cut_off = CUT_MARK.sub("", tail) if CUT_MARK.search(tail) else DOTS.sub("", tail)
    return (head + cut_off).rstrip(BLANKS)


def odd_ends(df: DataFrame, id_col: str, text_col: str, source_col: str, type_col: str | None) -> DataFrame:
    """The texts whose end is not plainly whole, with what it looks like:
    _id, _source, _shape, _text (without mark and blanks), _len, _marked, _dots, _open, _whole, _word."""
    kind = F.lower(F.col(type_col)) if type_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), kind.alias("_kind"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, seen, cores = [], [], []
            for r, (text, k) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_kind").to_pylist())):
                end = describe_end(text, k)
                if end is not None and (end[1] or end[2] or end[3] or not end[4]):
                    keep.append(r)
                    seen.append((len(text), *end))
                    cores.append(core_text(text))
            at = pa.array(keep, pa.int32())
            n, shape, marked, dots, is_open, whole, word = zip(*seen) if seen else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(at) for c in ("_id", "_source")], pa.array(cores, pa.string()), pa.array(n, pa.int32()), pa.array(shape, pa.string()),
                    *[pa.array(x, pa.bool_()) for x in (marked, dots, is_open, whole)], pa.array(word, pa.string()),
                ],
                names=["_id", "_source", "_text", "_len", "_shape", "_marked", "_dots", "_open", "_whole", "_word"],
            )

    id_kind, source_kind = (df.schema[c].dataType.simpleString() for c in (id_col, source_col))
    return rows.mapInArrow(
        run, f"_id {id_kind}, _source {source_kind}, _text string, _len int, _shape string, _marked boolean, _dots boolean, _open boolean, _whole boolean, _word string"
    )


def final_shares(df: DataFrame, text_col: str, type_col: str | None) -> DataFrame:
    """The share of each word's occurrences that end a sentence in the texts that are not code: _word, _final.

    Words are counted batch by batch, then summed.
    """
    rows = df if type_col is None else df.where(~F.coalesce(F.lower(type_col).isin(CODE_TYPES), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every: Counter[str] = Counter()
            final: Counter[str] = Counter()
            for text in batch.column("_text").to_pylist():
                low = text.lower()
                every.update(WORD.findall(low))
                final.update(FINAL_WORD.findall(low))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([final[w] for w in every], pa.int64())], names=["_word", "_n", "_m"]
            )

    counted = rows.where(F.length(text_col) > 0).select(F.col(text_col).alias("_text")).mapInArrow(run, "_word string, _n bigint, _m bigint")
    sums = counted.groupBy("_word").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    return sums.where("_m > 0").select("_word", (F.col("_m") / F.col("_n")).alias("_final"))


def field_limits(odd: DataFrame, slack: int = 24, least: int = 5) -> DataFrame:
    """Per source the length at which texts with marks of omission pile up: _source, _limit.

    Lengths are counted in windows of ``slack`` that overlap by half; the
    fullest window counts if it has ``least`` texts and a quarter of them all,
    and its most frequent length is the limit.
    """
    marked = odd.where((F.col("_dots") | F.col("_marked")) & ~F.col("_whole") & (F.col("_shape") == "prose"))
    lengths = marked.groupBy("_source", "_len").agg(F.count("*").alias("_n"))
    half = F.floor(F.col("_len") / (slack / 2))
    windows = lengths.withColumn("_w", F.explode(F.array(half, half - 1))).groupBy("_source", "_w").agg(F.sum("_n").alias("_n"), F.max(F.struct("_n", "_len")).alias("_mode"))
    alls = lengths.groupBy("_source").agg(F.sum("_n").alias("_all"))
    most = windows.groupBy("_source").agg(F.max(F.struct("_n", "_mode")).alias("_top")).join(alls, "_source")
    return most.where((F.col("_top._n") >= least) & (F.col("_top._n") * 4 >= F.col("_all"))).select("_source", F.col("_top._mode._len").alias("_limit"))


def prefix_copies(odd: DataFrame, texts: DataFrame, least: int = 20) -> DataFrame:
    """Texts of ``odd`` (_id, _text, _whole, _open) that are strict prefixes of
    longer ones of ``texts``, which go on with more than marks of omission and blanks (_id, _text): _id, _longer, the length of the longest
    such copy, _mid, whether one goes on inside a word.

    A text of length L with P <= L < 2P, P a power of two, looks among texts of
    the same first P characters by hash.  Per such hash only the distinct
    lengths asked for are kept.  The long texts first meet these as ids and
    hashes, without their content; those that do give the prefixes of just the
    lengths asked for, and equal hashes are verified on the text.  No step pairs
    the members of a group, and a hot prefix costs its rows once per length.
    """
    shorts = odd.where(~F.col("_whole") | F.col("_open")).select("_id", "_text", F.length("_text").alias("_len")).where(F.col("_len") >= least)
    level = F.expr("shiftleft(1, int(floor(log2(double(_len)))))")
    asked = shorts.withColumn("_p", level).withColumn("_key", F.xxhash64("_p", F.expr("substring(_text, 1, _p)")))
    lengths = asked.groupBy("_p", "_key").agg(F.collect_set("_len").alias("_ls"))
    longs = texts.select("_id", "_text", F.length("_text").alias("_len")).where(F.col("_len") > least)
    powers = F.expr("transform(sequence(4, int(floor(log2(double(_len))))), k -> shiftleft(1, k))")
    keys = longs.withColumn("_p", F.explode(powers)).select(
        "_id", "_len", "_p", F.xxhash64("_p", F.expr("substring(_text, 1, _p)")).alias("_key")
    )
    met = keys.join(lengths, ["_p", "_key"]).select("_id", F.explode("_ls").alias("_l"), "_len").where("_l < _len")
    wanted = met.select("_id", "_l").distinct()
    prefix = F.expr("substring(_text, 1, _l)")
    offers = (
        longs.join(wanted, "_id")
        .where("_l < _len")
        .where((F.col("_len") - F.col("_l") > 100) | ~F.expr("substring(_text, _l + 1)").rlike(ONLY_MARK))
        .select("_l", F.xxhash64(prefix).alias("_h"), prefix.alias("_prefix"), F.col("_len").alias("_n"), F.expr("substring(_text, _l, 2)").rlike(r"^[\p{L}\p{N}_]{2}$").alias("_mid"))
        .groupBy("_l", "_h", "_prefix")
        .agg(F.max("_n").alias("_longer"), F.max("_mid").alias("_mid"))
    )
    mine = asked.select("_id", F.col("_len").alias("_l"), F.xxhash64("_text").alias("_h"), F.col("_text").alias("_prefix"))
    return mine.join(offers, ["_l", "_h", "_prefix"]).groupBy("_id").agg(F.max("_longer").alias("_longer"), F.max("_mid").alias("_mid"))


def find_truncated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    type_col: str | None = "doc_type",
    slack: int = 24,
) -> DataFrame:
    """Every text that breaks off: ``id_col``, source, evidence, longer.

    Evidence: ``copy`` (a strict prefix of a longer text, and the end is not
    whole), ``mark`` (a machine's mark of omission after an end that is not
    whole), ``structure`` (open brackets, tags or fences), ``sentence`` (an end
    inside a word or sentence), ``limit`` (dots after a word that may end a
    sentence, at the length where the source's texts pile up).

    Defined cases: null and blank texts, list items, table rows and trailers
    give no row; a todo or title only with a mark, with dots inside a sentence,
    or if a longer copy goes on inside its last word; dots after a word of which
    FINAL_SHARE of all occurrences end sentences are a pause the author meant
    unless the length is the source's limit; a null source is a source of its own without a limit;
    repeated ids are judged each and given once; very long texts are judged by
    their whole brackets and their last 400 characters; clashing extra columns
    are ignored; an empty table gives an empty result.
    """
    odd = cut(odd_ends(df, id_col, text_col, source_col, type_col))
    limits = field_limits(odd, slack)
    final = final_shares(df, text_col, type_col)
    copies = prefix_copies(odd, df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    judged = odd.drop("_text").join(limits, "_source", "left").join(final, "_word", "left").join(copies, "_id", "left")
    known = F.coalesce(F.col("_final") >= FINAL_SHARE, F.lit(False))
    at_limit = F.coalesce((F.col("_len") <= F.col("_limit") + 6) & (F.col("_len") > F.col("_limit") - slack), F.lit(False))
    prose = F.col("_shape") == "prose"
    evidence = (
        F.when(
            F.col("_shape") == "title",
            F.when(F.col("_marked"), "mark").when(F.col("_mid") & ~F.col("_whole"), "copy").when(F.col("_dots") & ~F.col("_whole") & ~known, "sentence"),
        )
        .when(F.col("_marked") & ~F.col("_whole"), "mark")
        .when(F.col("_longer").isNotNull() & (~F.col("_whole") | F.col("_open")), "copy")
        .when(F.col("_open"), "structure")
        .when(prose & F.col("_dots") & ~F.col("_whole") & ~known, "sentence")
        .when(prose & F.col("_dots") & ~F.col("_whole") & at_limit, "limit")
        .when(prose & ~F.col("_dots") & ~F.col("_whole"), "sentence")
    )
    return (
        judged.withColumn("evidence", evidence)
        .where(F.col("evidence").isNotNull())
        .groupBy(F.col("_id").alias(id_col))
        .agg(F.min("_source").alias("source"), F.min("evidence").alias("evidence"), F.max("_longer").alias("longer"))
    )


def truncation_shares(df: DataFrame, found: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per source the number of texts, of truncated ones, and their share; a null source is kept as null."""
    hits = found.select(F.col(id_col).alias("_id"), F.lit(1).alias("_hit"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source")).join(hits, "_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("n_texts"),
        F.coalesce(F.sum("_hit"), F.lit(0)).cast("bigint").alias("n_truncated"),
        F.round(F.coalesce(F.sum("_hit"), F.lit(0)) / F.count("*"), 6).alias("truncated_share"),
    )
