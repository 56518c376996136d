"""Problem 5: generated, minified, vendored and data files among source files."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Folders that hold other people's code (fixed values); ``deps/src`` and a
#: folder named by package and version count as well.
VENDOR_PATH = (
    r"(?i)(^|/)(node_modules|bower_components|bower_modules|jspm_packages|vendor|vendored|_vendor|third[-_]?party|3rd[-_]?party|external|externals|extern"
    r"|site-packages|godeps|pods|carthage|deps/src)/"
)
VERSIONED_PATH = r"(^|/)(@[\w.-]+/)?[A-Za-z_][\w.]*[-@]v?\d+\.\d+(\.\d+)?[\w.-]*/"
#: File names that generators and bundlers give (fixed values).
GENERATED_NAME = (
    r"(?i)(\.(g|gen|generated|pb|pb\.gw|designer|idl|autogen)\.[a-z]+$|[-_.]generated\.[a-z]+$|_pb2(_grpc)?\.py$|_gen\.(go|rs|py|ts|js|php)$"
    r"|_string\.go$|_(idl|stub2)\.py$|(^|/)zz_generated[^/]*$)"
)
MINIFIED_NAME = r"(?i)([.-]min\.(js|css|mjs)$|\.bundle\.js$|\.chunk\.(js|css)$|-[0-9a-f]{8,}\.(js|css|mjs)$)"
#: What generators write above their output (fixed values), sought in the
#: comments before the first line of code.
GENERATED_MARK = re.compile(
    r"\bcode generated (?:by|from)\b|\bdo not (?:edit|modify|change)\b|\bauto-?\s?generated\b|@generated\b|\bgenerated (?:by|from|file|automatically|code|with)\b"
    r"|\bmachine[- ](?:made|generated|written)\b|\bproduced automatically\b|\bcreated automatically\b|\bchanges will be (?:lost|overwritten)\b"
    r"|\bgénéré\w* (?:par|automatiquement)\b|\bne pas modifier\b|\berzeugt\b.*\bnicht\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand\b"
    r"|\bgenerado (?:por|automáticamente)\b|\bno (?:editar|modificar)\b|自动生成|生成.*(?:勿|不要)|请勿",
    re.I,
)
#: What bundled libraries carry above their code (fixed values).
VENDOR_MARK = re.compile(
    r"@preserve\s+\S+\s+v?\d+\.\d+|(?:/\*!|\*|//!?)\s*@?[\w./@-]+\s+v\d+\.\d+(?:\.\d+)?\b|@license\s+\S+\s+v?\d+\.\d+|distributed as is under", re.I
)
_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|#[0-9a-fA-F]{3,8}\b|\b\d[\w.]*|[A-Za-z_$][\w$]*|[^\w\s]",
    re.S,
)
_KEYWORDS = frozenset(
    "import from export default const let var function return if else for while do switch case break continue class struct type interface func package use pub fn impl "
    "mut self this new None null nil True False true false async await def pass raise try except finally throw throws catch public private protected static void int string "
    "bool boolean number float err in of is not and or with as yield lambda enum match loop where trait mod crate super extends implements readonly namespace require".split()
)
_IMPORT = re.compile(r"^\s*(?:import\b[^\n(]*|from\b[^\n]*\bimport\b[^\n]*|use\b[^\n]*;|package\b[^\n]*|<\?php[^\n]*|import\s*\([^)]*\))", re.M)
WORDS = 5
#: Bands of the masked shingles and of the shingles as they are.
BANDS, ROWS = 20, 3
COPY_ROWS = 4
_rng = np.random.default_rng(7)
#: Odd factors of 64 bits, so that products wrap around: without that all hashes would have one order.
_MUL = _rng.integers(1 << 62, 1 << 63, BANDS * COPY_ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * COPY_ROWS, dtype=np.uint64)
#: Paths of one repository that make a generated family of their own if their
#: masked shingles are equal and their tokens are not.
FAMILY_FROM = 3
#: Share of literals from which a cluster is data.
LITERALS = 0.7


def file_content(records: Column) -> Column:
    """The text of a file from its pieces, by the number that ends their ids; nulls are left out."""
    pieces = F.filter(records, lambda r: r.isNotNull() & r["content"].isNotNull())
    numbered = F.transform(pieces, lambda r: F.struct(F.regexp_extract(r["id"], r"(\d+)$", 1).try_cast("int").alias("n"), r["content"].alias("c")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda r: r["c"]), "")


def header_comments(text: str) -> str:
    """The comments before the first line of code."""
    out, block = [], False
    for line in re.finditer(r"[^\n]+", text):
        s = line[0].strip()
        if block:
            out.append(s)
            block = "*/" not in s
        elif not s or s.startswith(("<?php", "#!", "'use strict'", '"use strict"')):
            if "/*" in s:
                out.append(s)
                block = "*/" not in s.rsplit("/*", 1)[1]
        elif s.startswith(("//", "#", "<!--", "--", ";")):
            out.append(s)
        elif s.startswith("/*"):
            out.append(s)
            block = "*/" not in s[2:]
        elif s.startswith(('"""', "'''")):
            out.append(s)
            break
        else:
            break
    return "\n".join(out)


def _runs(v: np.ndarray) -> np.ndarray:
    """Distinct hashes of WORDS tokens in a row."""
    h = np.zeros(len(v) - WORDS + 1, dtype=np.uint64)
    for k in range(WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[k : len(v) - WORDS + 1 + k]
    h = (h ^ (h >> np.uint64(29))) >> np.uint64(16) & np.uint64(0x7FFFFFFF)
    return np.unique(h).astype(np.uint32)


def _masked(token: str) -> str:
    """What stands for a token: ``S`` for strings, ``0`` for numbers, ``i`` for names, keywords and signs themselves."""
    c = token[0]
    if c.isascii() and (c.isalpha() or c in "_$") and token != "$":
        return token if token in _KEYWORDS else "i"
    if c.isdigit() or c == "#" and len(token) > 1:
        return "0"
    return "S" if len(token) > 1 else token


class Shingles:
    """The distinct hashes of five tokens in a row of one text, without its
    comments and imports: ``masked`` (names and literals masked, keywords and
    signs kept) and ``plain`` (the tokens as they are); ``n`` tokens, of whose
    ``size`` characters ``literal`` belong to literals; ``exact`` stands for the
    tokens in their order."""

    def __init__(self, text: str) -> None:
        tokens = [t for t in _TOKEN.findall(_IMPORT.sub(" ", text)) if not t.startswith(("//", "/*"))]
        counts = Counter(tokens)
        mask = {t: _masked(t) for t in counts}
        self.n = len(tokens)
        self.size = sum(len(t) * k for t, k in counts.items())
        self.literal = sum(len(t) * k for t, k in counts.items() if mask[t] in "S0,\\")
        self.exact = int.from_bytes(hashlib.blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        self.masked = self.plain = np.empty(0, np.uint32)
        if self.n >= WORDS:
            codes = {m: zlib.crc32(m.encode()) for m in set(mask.values())}
            hidden = {t: codes[m] for t, m in mask.items()}
            shown = {t: zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in counts}
            self.masked = _runs(np.array([hidden[t] for t in tokens], dtype=np.uint64))
            self.plain = _runs(np.array([shown[t] for t in tokens], dtype=np.uint64))

    @property
    def literal_share(self) -> float:
        return self.literal / max(1, self.size)


def bands(shingles: np.ndarray, rows: int = ROWS) -> list[int]:
    """Keys of the MinHash bands."""
    n = BANDS * rows
    mixed = shingles.astype(np.uint64)[:, None] * _MUL[:n] + _ADD[:n]
    low = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).min(0).reshape(BANDS, rows)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(rows):
        keys = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ low[:, r]
    return keys.astype(np.int64).tolist()


def parities(shingles: np.ndarray) -> list[int]:
    """Whether an odd number of shingles falls into each of 256 parts, as four numbers of 64 bits: two sets differ
    in at least as many shingles as bits."""
    parts = (shingles.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
    return np.packbits((np.bincount(parts, minlength=256) & 1).astype(np.uint8)).view(np.int64).tolist()


def is_minified(text: str) -> bool:
    """Nearly all characters in long lines, and hardly a blank among them."""
    size = max(1, len(text))
    long = sum(len(x) for x in text.split("\n") if len(x) > 300) / size
    return long >= 0.8 and sum(map(text.count, " \t\n")) / size < 0.16


def describe_files(df: DataFrame, id_col: str, path_col: str, group_col: str, records_col: str, min_tokens: int, features: bool) -> DataFrame:
    """_id, _path, _group, _label (what path or content tell by themselves), _exact, _literal, _size,
    _sid (stands for the masked shingles), _set, _bands, _odd (parities), _plain, _copy (bands of the plain shingles)."""
    path = F.coalesce(F.col(path_col), F.lit(""))
    by_path = (
        F.when(path.rlike(VENDOR_PATH) | path.rlike(VERSIONED_PATH), "vendored").when(path.rlike(MINIFIED_NAME), "minified").when(path.rlike(GENERATED_NAME), "generated")
    )
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), path.alias("_path"), F.col(group_col).cast("string").alias("_group"),
        (by_path if features else F.lit(None).cast("string")).alias("_by_path"), file_content(F.col(records_col)).alias("_text"),
    )
    kind = df.schema[id_col].dataType.simpleString()
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text in zip(batch.column("_by_path").to_pylist(), batch.column("_text").to_pylist()):
                text = (text or "").lstrip("\ufeff").replace("\r\n", "\n")
                s = Shingles(text)
                if features and text and label is None:
                    head = header_comments(text)
                    if GENERATED_MARK.search(head):
                        label = "generated"
                    elif VENDOR_MARK.search(head):
                        label = "vendored"
                    elif s.literal_share >= LITERALS and s.n >= 40 or s.literal_share >= 0.8 and len(text) >= 400:
                        label = "data"
                    elif is_minified(text):
                        label = "minified"
                if s.n >= min_tokens and len(s.masked):
                    sid = int.from_bytes(hashlib.blake2b(s.masked.tobytes(), digest_size=8).digest(), "big", signed=True)
                    out.append((label, s.exact, s.literal, s.size, sid, s.masked.astype(np.int32), bands(s.masked), parities(s.masked), s.plain.astype(np.int32), bands(s.plain, COPY_ROWS)))
                else:
                    out.append((label, s.exact, s.literal, s.size, None, None, None, None, None, None))
            columns = list(zip(*out)) or [()] * 10
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), ints, longs, longs, ints, longs)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_id", "_path", "_group")], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["_id", "_path", "_group", "_label", "_exact", "_literal", "_size", "_sid", "_set", "_bands", "_odd", "_plain", "_copy"],
            )

    return rows.mapInArrow(
        run, f"_id {kind}, _path string, _group string, _label string, _exact bigint, _literal bigint, _size bigint, _sid bigint, "
        "_set array<int>, _bands array<bigint>, _odd array<bigint>, _plain array<int>, _copy array<bigint>"
    )


def matches(asked: DataFrame, offered: DataFrame, left: DataFrame, right: DataFrame, similarity: float, also: str = "true") -> DataFrame:
    """Distinct ids (_x) of ``asked`` (_k, _x, ...) that meet an entry of ``offered`` (_k, _y, ...) on a band key, fulfil ``also``
    and share ``similarity`` of their shingles: ``left`` (_x, _sx) and ``right`` (_y, _sy).

    An id first meets the entries with the least and the greatest id of each of
    its keys; one without a match then meets all entries of all its keys.
    """
    ends = offered.groupBy("_k").agg(F.min("_y").alias("_y0"), F.max("_y").alias("_y1")).select("_k", F.explode(F.array_distinct(F.array("_y0", "_y1"))).alias("_y"))

    def near(asks: DataFrame, others: DataFrame) -> DataFrame:
        pairs = asks.join(others, "_k").where(f"_x != _y AND ({also})").select("_x", "_y").distinct()
        both = pairs.join(left, "_x").join(right, "_y").withColumn("_c", F.size(F.array_intersect("_sx", "_sy")))
        return both.where(F.col("_c") >= F.lit(similarity - 1e-12) * (F.size("_sx") + F.size("_sy") - F.col("_c"))).select("_x").distinct()

    first = cut(near(asked, offered.join(ends, ["_k", "_y"], "left_semi")))
    return first.unionByName(near(asked.join(first, "_x", "left_anti"), offered))


def candidates(posts: DataFrame, others: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs _x of ``posts``, _y of ``others`` (both _k, _sid, _w, _odd) on a band key that sizes and parities
    don't rule out, with the number of parities that differ (_h)."""
    a, b = posts.select("_k", F.col("_sid").alias("_x"), F.col("_w").alias("_wx"), F.col("_odd").alias("_ox")), others.select("_k", F.col("_sid").alias("_y"), F.col("_w").alias("_wy"), F.col("_odd").alias("_oy"))
    differ = " + ".join(f"bit_count(_ox[{i}] ^ _oy[{i}])" for i in range(4))
    possible = f"_x != _y AND least(_wx, _wy) >= greatest(_wx, _wy) * {similarity!r} - 1e-9 AND {differ} <= (_wx + _wy) * {(1 - similarity) / (1 + similarity)!r} + 1e-9"
    return a.join(b, "_k").where(possible).selectExpr("_x", "_y", f"{differ} AS _h").distinct()


def verified(pairs: DataFrame, shapes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (_x, _y) that share ``similarity`` of their shingles, and how much they share (_s)."""
    both = pairs.join(shapes.select(F.col("_sid").alias("_y"), F.col("_set").alias("_sy")), "_y").join(shapes.select(F.col("_sid").alias("_x"), F.col("_set").alias("_sx")), "_x")
    both = both.withColumn("_c", F.size(F.array_intersect("_sx", "_sy"))).withColumn("_u", F.size("_sx") + F.size("_sy") - F.col("_c"))
    return both.where(F.col("_c") >= F.lit(similarity - 1e-12) * F.col("_u")).select("_x", "_y", (F.col("_c") / F.col("_u")).alias("_s"))


def clusters(files: DataFrame, similarity: float, share: float) -> DataFrame:
    """_sid, _told: what the clusters of masked shingles tell of a set of them.

    Three paths of one repository with one set and different tokens are the
    core of a generated family.  The sets of at least two paths that are nearly
    all literals are data.  Sets with a told file are told.  A set that is not
    told itself is told if it reaches ``similarity`` to a told one and ``share``
    of the paths of all sets to which it reaches ``similarity`` are told; at
    ``share`` exactly, if its nearest set is told.  Every link to a told set is
    verified.  Links to the others are verified for the sets with such a link,
    those with the fewest differing parities first; where these outweigh the
    told ones already, the rest can't change the result.
    """
    light = files.where(F.col("_sid").isNotNull()).select(
        "_sid", "_group", "_path", "_exact", F.col("_literal"), "_size", F.when(F.col("_label") != "vendored", F.col("_label")).alias("_own"), (F.col("_label") == "vendored").alias("_lib")
    )
    cores = (
        light.where(F.col("_group").isNotNull() & ~F.coalesce("_lib", F.lit(False))).groupBy("_sid", "_group")
        .agg(F.countDistinct("_path").alias("_n"), F.countDistinct("_exact").alias("_m"))
        .where(F.least("_n", "_m") >= FAMILY_FROM).select("_sid").distinct().withColumn("_core", F.lit("generated"))
    )
    paths = light.groupBy("_sid", "_path").agg(F.sum("_literal").alias("_literal"), F.sum("_size").alias("_size"), F.min("_own").alias("_own"))
    sets = paths.groupBy("_sid").agg(F.count("*").alias("_n"), F.sum("_literal").alias("_literal"), F.sum("_size").alias("_size"), F.min("_own").alias("_own"))
    blob = F.when((F.col("_n") > 1) & (F.col("_literal") >= F.col("_size") * LITERALS), "data")
    told = cut(sets.join(cores, "_sid", "left").select("_sid", "_n", F.coalesce("_own", blob, "_core").alias("_told")))
    shapes = cut(files.where(F.col("_sid").isNotNull()).groupBy("_sid").agg(F.first("_set").alias("_set"), F.first("_bands").alias("_bands"), F.first("_odd").alias("_odd")))
    posts = shapes.select("_sid", F.explode("_bands").alias("_k"), F.size("_set").alias("_w"), "_odd").join(told.select("_sid", F.col("_told").isNull().alias("_open")), "_sid")
    weights = told.select(F.col("_sid").alias("_y"), "_n", "_told")
    links = cut(verified(candidates(posts.where("_open"), posts.where("NOT _open"), similarity), shapes, similarity).join(weights, "_y"))
    kinds = links.groupBy("_x", "_told").agg(F.sum("_n").alias("_v"), F.max("_s").alias("_near"))
    votes = cut(kinds.groupBy("_x").agg(F.sum("_v").alias("_known"), F.max("_near").alias("_near"), F.max_by("_told", F.struct("_v", "_told")).alias("_told")))

    def judged(asks: DataFrame, pairs: DataFrame) -> DataFrame:
        """``asks`` with the share of told paths: _over if at least ``share``, _at if exactly that and another set is as near."""
        met = verified(pairs, shapes, similarity).join(weights.select("_y", "_n"), "_y").groupBy("_x").agg(F.sum("_n").alias("_others"), F.max("_s").alias("_other"))
        wanted = (F.col("_known") + F.coalesce("_others", F.lit(0))) * F.lit(share)
        tie = (F.col("_known") == wanted) & (F.col("_near") <= F.coalesce("_other", F.lit(0.0)))
        return asks.join(met, "_x", "left").select(*asks.columns, (F.col("_known") >= wanted).alias("_over"), tie.alias("_at"))

    # the other sets met, numbered from the likest on; the first of them decide for most
    asked = posts.join(votes.select(F.col("_x").alias("_sid")), "_sid", "left_semi")
    by_likeness = Window.partitionBy("_x").orderBy("_h", "_y")
    met = cut(candidates(asked, posts.where("_open"), similarity).withColumn("_r", F.row_number().over(by_likeness)).select("_x", "_y", "_r"))
    some = met.join(votes.select("_x", (F.col("_known") * F.lit(2 * (1 / max(share, 0.01) - 1)) + 8).alias("_to")), "_x").where("_r <= _to").select("_x", "_y")
    left = cut(judged(votes, some).where("_over").drop("_over", "_at"))
    grown = judged(left, met.join(left, "_x", "left_semi").select("_x", "_y")).where("_over AND NOT _at").select(F.col("_x").alias("_sid"), "_told")
    return told.where("_told IS NOT NULL").select("_sid", "_told").unionByName(grown)


def copied_libraries(files: DataFrame, similarity: float) -> DataFrame:
    """_exact of token sequences that another repository or a vendored file has as well, to ``similarity`` of their shingles as they are."""
    entries = cut(
        files.where(F.col("_sid").isNotNull()).groupBy("_exact").agg(
            F.min("_group").alias("_a"), F.max("_group").alias("_z"), F.max(F.coalesce(F.col("_label") == "vendored", F.lit(False))).alias("_lib"),
            F.max(F.col("_label").isNull()).alias("_open"), F.first("_plain").alias("_plain"), F.first("_copy").alias("_copy"),
        )
    )
    equal = entries.where("_a < _z").select("_exact")
    keys = entries.select(F.explode("_copy").alias("_k"), F.col("_exact").alias("_x"), "_a", "_z", "_lib", "_open", F.size("_plain").alias("_n"))
    # only keys that several repositories, or a vendored file and another one, have
    shared = keys.groupBy("_k").agg(F.count("*").alias("_c"), F.min("_a").alias("_g0"), F.max("_z").alias("_g1"), F.max("_lib").alias("_l")).where("_c > 1 AND (_g0 < _g1 OR _l)").select("_k")
    keys = cut(keys.join(shared, "_k", "left_semi"))
    asked = keys.where("_open AND NOT coalesce(_a < _z, false)").select("_k", "_x", "_a", "_n")
    offered = keys.select("_k", F.col("_x").alias("_y"), F.col("_a").alias("_oa"), F.col("_z").alias("_oz"), F.col("_lib").alias("_ol"), F.col("_n").alias("_on"))
    apart = f"(_ol OR _oa != _a OR _oz != _a) AND least(_n, _on) >= greatest(_n, _on) * {similarity!r} - 1e-9"
    left, right = entries.select(F.col("_exact").alias("_x"), F.col("_plain").alias("_sx")), entries.select(F.col("_exact").alias("_y"), F.col("_plain").alias("_sy"))
    return equal.unionByName(matches(asked, offered, left, right, similarity, apart).select(F.col("_x").alias("_exact")))


def not_handwritten(
    df: DataFrame,
    id_col: str = "result_id",
    path_col: str = "rel_path",
    group_col: str = "project_id",
    records_col: str = "records",
    similarity: float = 0.8,
    min_tokens: int = 80,
    share: float = 0.5,
    features: bool = True,
) -> DataFrame:
    """Files nobody wrote by hand: ``id_col``, reason (generated, minified, vendored or data), evidence (own or family).

    All files of at least ``min_tokens`` tokens, by their distinct sets of
    shingles of five tokens with identifiers and literals masked, are clustered
    (``clusters``): families of one repository are generated, clusters of
    literals alone are data, and what is near to them is of their kind.  A file
    of which another repository or a vendored file has ``similarity`` of the
    shingles as they are counts as vendored (``copied_libraries``).  With
    ``features`` a file's own path, a generator's or a library's mark before the
    first line of code, long lines almost without blanks and code that is nearly
    all literals tell it as well, and it tells others of its cluster.

    Defined cases: a result without content is told by its path alone; null
    records, contents and paths count as empty; pieces are joined by the number
    that ends their ids; rows delivered twice give one row; CRLF and byte-order
    marks do not matter; shorter files join no cluster; a null group is no
    repository; very long files are read whole; other columns are ignored; an
    empty table gives an empty result.
    """
    files = cut(describe_files(df, id_col, path_col, group_col, records_col, min_tokens, features))
    own = files.where(F.col("_label").isNotNull()).groupBy("_id").agg(F.min("_label").alias("_label")).withColumn("_why", F.lit("own"))
    rest = files.where(F.col("_label").isNull() & F.col("_sid").isNotNull()).select("_id", "_sid", "_exact")
    copied = rest.join(copied_libraries(files, similarity).distinct(), "_exact", "left_semi").select("_id", F.lit("vendored").alias("_label"))
    grown = rest.join(clusters(files, similarity, share), "_sid").select("_id", F.col("_told").alias("_label"))
    # a copied library goes before a family
    found = grown.withColumn("_r", F.lit(1)).unionByName(copied.withColumn("_r", F.lit(0))).groupBy("_id").agg(F.min_by("_label", F.struct("_r", "_label")).alias("_label"))
    found = found.withColumn("_why", F.lit("family")).join(own.select("_id"), "_id", "left_anti")
    return own.unionByName(found).select(F.col("_id").alias(id_col), F.col("_label").alias("reason"), F.col("_why").alias("evidence"))
