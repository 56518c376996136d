"""Problem 4: records that are mostly the same, by prefix filters under several global token orders."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A word is a run of letters, digits and ``_``, in lower case (fixed value).
WORD = re.compile(r"\w+")
#: Copies of one text (the same words in the same order) up to which all their pairs are given; beyond that a star.
STAR_FROM = 64
#: Buckets of the frequency sketch that sets the token orders; its size is the
#: only thing every task gets.
SKETCH = 1 << 18
#: Hashes of words kept by a task.
_CACHED = 500_000


def word_bags(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """_id, _key (stands for the multiset of words), _seq (for the words in their order), _toks of the texts with enough words.

    A word occurring n times is n tokens, 64-bit hashes of (word, 1..n).
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], int] = {}

        def token(word: str, k: int) -> int:
            t = known.get((word, k))
            if t is None:
                if len(known) > _CACHED:
                    known.clear()
                t = int.from_bytes(hashlib.blake2b(f"{word} {k}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                known[word, k] = t
            return t

        for batch in batches:
            keep, keys, seqs, bags = [], [], [], []
            for r, text in enumerate(batch.column("_text").to_pylist()):
                words = WORD.findall(text.lower())
                if len(words) < min_words:
                    continue
                toks = np.array([token(w, k) for w, n in Counter(words).items() for k in range(1, n + 1)], dtype=np.int64)
                toks.sort()
                keep.append(r)
                keys.append(hashlib.blake2b(toks.tobytes(), digest_size=16).hexdigest())
                seqs.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                bags.append(toks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(keep, pa.int32())), pa.array(keys, pa.string()), pa.array(seqs, pa.string()), pa.array(bags, pa.list_(pa.int64()))],
                names=["_id", "_key", "_seq", "_toks"],
            )

    return rows.mapInArrow(run, "_id bigint, _key string, _seq string, _toks array<bigint>")


def classes(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with the same words as often as each other: ``(members, reps)``.

    ``members``: _id, _rep (the smallest id of the class), _size, _copy (the
    smallest id with the words in the same order), _copies.  ``reps``: _rep, _toks.
    """
    ids = cut(bags.groupBy("_id").agg(F.min(F.struct("_key", "_seq")).alias("_k")).select("_id", "_k.*"))
    firsts = ids.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_size"))
    texts = ids.groupBy("_key", "_seq").agg(F.min("_id").alias("_copy"), F.count("*").alias("_copies"))
    members = ids.join(texts, ["_key", "_seq"]).join(firsts, "_key").select("_id", "_rep", "_size", "_copy", "_copies")
    reps = bags.groupBy("_key").agg(F.first("_toks").alias("_toks")).join(firsts, "_key").select("_rep", "_toks")
    return members, reps


def frequency_sketch(reps: DataFrame) -> np.ndarray:
    """Tokens per bucket over all classes: a fixed number of sums, each task adding up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(batch.column("_toks").flatten().to_numpy(zero_copy_only=False) & (SKETCH - 1), minlength=SKETCH)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["b", "n"])

    out = np.zeros(SKETCH, dtype=np.int64)
    found = reps.select("_toks").mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return out


def with_orders(reps: DataFrame, sketch: np.ndarray, t: float) -> DataFrame:
    """Adds the size, the prefixes under the three orders and the parity bitmaps to each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, at, second, third, bits = [], [], [], [], [], []
            for toks in batch.column("_toks"):
                x = toks.values.to_numpy()
                n = len(x)
                lean = n - int(np.ceil(n * t - 1e-9)) + 1
                df, side = sketch[x & (SKETCH - 1)], (x >> 40) & 1
                o1 = np.lexsort((x, df))[:lean]
                pos = np.flatnonzero(df[o1] > 1)  # a token of a single text is no key
                sizes.append(n)
                first.append(x[o1[pos]])
                at.append(pos.astype(np.int32))
                second.append(x[np.lexsort((x, df, side))[:lean]].astype(np.int32))
                third.append(x[np.lexsort((x, df, 1 - side))[:lean]].astype(np.int32))
                parity = np.bincount((x >> 8) & 255, minlength=256) & 1
                bits.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            b = np.array(bits, dtype=np.int64).reshape(-1, 4)
            n = np.array(sizes, dtype=np.int32)
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_rep"), batch.column("_toks"), pa.array(n),
                 pa.array(first, longs), pa.array(at, ints), pa.array(second, ints), pa.array(third, ints), *[pa.array(b[:, q]) for q in range(4)]],
                names=["_rep", "_toks", "_s", "_p1", "_at", "_p2", "_p3", "_b0", "_b1", "_b2", "_b3"],
            )

    return reps.mapInArrow(
        run, "_rep bigint, _toks array<bigint>, _s int, _p1 array<bigint>, _at array<int>, _p2 array<int>, _p3 array<int>, _b0 bigint, _b1 bigint, _b2 bigint, _b3 bigint"
    )


def similar_classes(reps: DataFrame, t: float, sketch: np.ndarray | None = None) -> DataFrame:
    """Pairs of classes whose multisets of words have a Jaccard of at least ``t``: _a < _b, similarity.

    Three global orders of the tokens, all by rising frequency (of a sketch; any
    fixed order is right, a good one is fast): the first of all tokens, the
    second with one half of a hashed vocabulary before the other, the third the
    other way round.  A pair can only reach ``t`` if its prefixes of
    |x| - ceil(t |x|) + 1 tokens meet under each order.  The first order's
    prefix, of the rarest tokens, is the join key, with bounds of length and
    position and parity bitmaps of 256 bits, a lower
    bound of the tokens that differ.  The pairs left are intersected with the
    two other orders by their short prefixes, and only what meets there too is
    joined with the tokens and compared.  All bounds are exact: no pair is lost.
    A token in a single text is no key.
    """
    ordered = cut(with_orders(reps, frequency_sketch(reps) if sketch is None else sketch, t))
    bits = ["_b0", "_b1", "_b2", "_b3"]
    posts = ordered.select("_rep", "_s", *bits, F.explode(F.arrays_zip("_p1", "_at")).alias("_x")).select(
        F.col("_x._p1").alias("_t"), F.col("_x._at").alias("_pos"), "_rep", "_s", *bits
    )
    a, b = posts.alias("a"), posts.alias("b")  # one exchange serves both; a is the smaller one
    shared = F.ceil((F.col("a._s") + F.col("b._s")) * (t / (1 + t)) - 1e-9)
    rest = F.least(F.col("a._s") - F.col("a._pos"), F.col("b._s") - F.col("b._pos"))
    differ = sum((F.bit_count(F.col(f"a.{q}").bitwiseXOR(F.col(f"b.{q}"))) for q in bits[1:]), F.bit_count(F.col("a._b0").bitwiseXOR(F.col("b._b0"))))
    close = (
        ((F.col("a._s") < F.col("b._s")) | ((F.col("a._s") == F.col("b._s")) & (F.col("a._rep") < F.col("b._rep"))))
        & (F.col("a._s") >= F.ceil(F.col("b._s") * t - 1e-9))
        & (rest + F.least("a._pos", "b._pos") >= shared)
        & (differ <= F.col("a._s") + F.col("b._s") - 2 * shared)
    )
    pairs = a.join(b, (F.col("a._t") == F.col("b._t")) & close).select(F.least("a._rep", "b._rep").alias("_a"), F.greatest("a._rep", "b._rep").alias("_b")).distinct()
    short = ordered.select("_rep", "_p2", "_p3")
    left = short.select(F.col("_rep").alias("_a"), F.col("_p2").alias("_a2"), F.col("_p3").alias("_a3"))
    right = short.select(F.col("_rep").alias("_b"), F.col("_p2").alias("_b2"), F.col("_p3").alias("_b3"))
    met = cut(pairs.join(left, "_a").join(right, "_b").where(F.arrays_overlap("_a2", "_b2") & F.arrays_overlap("_a3", "_b3")).select("_a", "_b"))
    asked = met.select(F.explode(F.array("_a", "_b")).alias("_rep")).distinct()
    sets = ordered.select("_rep", "_toks").join(asked, "_rep", "left_semi")
    both = met.join(sets.select(F.col("_rep").alias("_a"), F.col("_toks").alias("_sa")), "_a").join(sets.select(F.col("_rep").alias("_b"), F.col("_toks").alias("_sb")), "_b")
    either: Column = F.size("_sa") + F.size("_sb") - F.col("_common")
    return (
        both.withColumn("_common", F.size(F.array_intersect("_sa", "_sb")))
        .where(F.col("_common") >= F.lit(t - 1e-12) * either)
        .select("_a", "_b", (F.col("_common") / either).alias("similarity"))
    )


def near_duplicates(
    df: DataFrame, id_col: str = "rec_no", text_col: str = "content", t: float = 0.7, min_words: int = 20
) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: links between classes of equal bags of words, and each row's class.

    ``links``: _a < _b (smallest ids of two classes), similarity.  ``members``:
    _id, _rep, _size, _copy, _copies.  Together they hold every pair of texts that reach ``t``:
    the members of a class are mutual copies, and a link holds for each member
    of the one class with each of the other.

    Defined cases: null ids, null texts and texts of fewer than ``min_words``
    words take no part; repeated ids count once, with the text of the least key; order
    and white space do not matter; two texts exactly at ``t`` are a pair; very
    long texts are compared whole; other columns are ignored; an empty table
    gives empty results.
    """
    bags = cut(word_bags(df, id_col, text_col, min_words))
    members, reps = classes(bags)
    # the frequencies of all rows order the tokens as well as those of the classes do
    return similar_classes(reps, t, frequency_sketch(bags)), members


def near_duplicate_pairs(links: DataFrame, members: DataFrame, star_from: int = STAR_FROM) -> DataFrame:
    """Pairs of different ids, rec_a < rec_b.

    Copies have the same words in the same order.  Up to ``star_from`` of them
    give all their pairs; more are a star around their smallest id, which alone
    stands for them.  All different texts of a class, and of linked classes,
    are paired, whatever the size of the classes.
    """
    star = members.where((F.col("_copies") > star_from) & (F.col("_id") != F.col("_copy"))).select(
        F.col("_copy").alias("rec_a"), F.col("_id").alias("rec_b")
    )
    stands = members.where((F.col("_copies") <= star_from) | (F.col("_id") == F.col("_copy")))
    left, right = stands.select("_rep", F.col("_id").alias("rec_a")), stands.select("_rep", F.col("_id").alias("rec_b"))
    inside = left.join(right, "_rep").where("rec_a < rec_b").select("rec_a", "rec_b")
    across = (
        links.join(stands.select(F.col("_rep").alias("_a"), F.col("_id").alias("_ia")), "_a")
        .join(stands.select(F.col("_rep").alias("_b"), F.col("_id").alias("_ib")), "_b")
        .select(F.least("_ia", "_ib").alias("rec_a"), F.greatest("_ia", "_ib").alias("rec_b"))
    )
    return inside.unionByName(star).unionByName(across)


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """Connected groups of near duplicates: id, group_id (the smallest id of the group), n_links.

    Large-star/small-star rounds over the class links until nothing changes;
    each round is a shuffle of the links and the lineage is cut by a checkpoint.
    """
    edges = cut(links.select(F.col("_a").alias("u"), F.col("_b").alias("v")))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        joined = small.join(low, "u")
        fresh = (
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        fresh = cut(fresh)
        same = fresh.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        old = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        edges = fresh
        if same == old:
            break
    group = edges.select(F.col("u").alias("_rep"), F.col("v").alias("_group"))
    degree = (
        links.select(F.col("_a").alias("_rep"))
        .unionByName(links.select(F.col("_b").alias("_rep")))
        .groupBy("_rep")
        .agg(F.count("*").alias("_links"))
    )
    return (
        members.join(group, "_rep", "left")
        .join(degree, "_rep", "left")
        .select(
            F.col("_id").alias("id"), F.coalesce("_group", "_rep").alias("group_id"), F.col("_rep").alias("class_id"),
            F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("_size").alias("n_copies"),
        )
    )
