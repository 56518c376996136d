"""Problem 6: token ids of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator that encodes.
TOKENIZER_DIR = "/opt/tokenizers"
#: Vocabulary used where none is named, and how its bytes are pre-tokenised
#: (fixed value, must equal the public tokenizer's pattern).
VOCABULARY = "byte_bpe_50k"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The vocabulary as an encoder, without special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pretoken_ends(pattern, text: str, lo: int, hi: int) -> list[int]:
    """Ends in [lo, hi] of pre-tokens that do not end in white space, scanning from the start.

    How a run of white space falls apart depends on what follows it, so a piece
    must not end with one.
    """
    return [e for e in (m.end() for m in pattern.finditer(text)) if lo <= e <= hi and not text[e - 1].isspace()]


def chunk_bounds(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of ``size`` characters; each also holds ``overlap`` characters of the next one."""
    return [(a, min(n, a + size + overlap)) for a in range(0, n, size)]


def encode_corpus(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = TOKENIZER_DIR,
    name: str = VOCABULARY,
    chunk_chars: int = 65536,
    overlap_chars: int = 2048,
    ids_col: str = "ids",
) -> DataFrame:
    """Token ids of every text: ``id_col``, ``ids_col`` (array of int), one row per input row.

    Texts of at most ``chunk_chars`` are one chunk and are encoded where they
    lie, without a shuffle.  Longer ones are cut into chunks that overlap; the
    chunks are pre-tokenised in parallel, stitched at the first pre-token
    boundary both neighbours see, and the resulting pieces encoded in parallel
    and put together in order.  The ids equal those of encoding each text whole.

    Defined cases: null and empty texts have an empty list; repeated ids are
    encoded row by row; texts that hold the strings of special tokens are
    ordinary text; a lone surrogate cannot occur in Spark strings; clashing
    extra columns are ignored; an empty table gives an empty result.
    """
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("the overlap must be positive and no larger than a chunk")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = F.length("_text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(folder, name).encode_ordinary
        for batch in batches:
            ids = [encode(t) if t else [] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, ids_col]
            )

    schema = f"`{id_col}` {kind}, `{ids_col}` array<int>"
    short = rows.where(n.isNull() | (n <= chunk_chars)).mapInArrow(whole, schema)
    pieces = long_text_pieces(rows.where(n > chunk_chars), folder, name, chunk_chars, overlap_chars)

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoding(folder, name).encode_ordinary
        for batch in batches:
            yield pd.DataFrame(
                {"_row": batch["_row"], "_id": batch["_id"], "_no": batch["_no"], "_ids": [encode(t) for t in batch["_piece"]]}
            )

    long = (
        pieces.mapInPandas(encode_pieces, f"_row string, _id {kind}, _no int, _ids array<int>")
        .groupBy("_row")
        .agg(F.first("_id").alias(id_col), F.array_sort(F.collect_list(F.struct("_no", "_ids"))).alias("_all"))
        .select(id_col, F.flatten(F.col("_all._ids")).alias(ids_col))
    )
    return short.unionByName(long)


def long_text_pieces(long: DataFrame, folder: str, name: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Pieces of long texts that begin and end on pre-token boundaries: _row, _id, _no, _piece.

    Rows are told apart by id and content, as ids may repeat.
    """
    kind = long.schema["_id"].dataType.simpleString()
    keyed = long.select(
        F.concat_ws(":", F.col("_id").cast("string"), F.sha2("_text", 256)).alias("_row"), "_id", "_text"
    )
    keyed = keyed.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text"), F.count("*").alias("_n"))

    def explode_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["_row"], batch["_text"]):
                for k, (a, b) in enumerate(chunk_bounds(len(text), chunk_chars, overlap_chars)):
                    yield pd.DataFrame({"_row": [row], "_no": [k], "_at": [a], "_chunk": [text[a:b]], "_end": [b == len(text)]})

    def boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(PATTERN)
        for batch in batches:
            heads, tails = [], []
            for at, chunk, end in zip(batch["_at"], batch["_chunk"], batch["_end"]):
                heads.append([int(at) + e for e in _pretoken_ends(pattern, chunk, 1, overlap_chars)])
                # a pre-token near the end of the chunk may go on in the next one
                stop = 0 if end else len(chunk.rstrip()) - 4
                tails.append([] if end else [int(at) + e for e in _pretoken_ends(pattern, chunk, chunk_chars + 1, stop)])
            yield pd.DataFrame({"_row": batch["_row"], "_no": batch["_no"], "_head": heads, "_tail": tails})

    marks = (
        keyed.select("_row", "_text")
        .mapInPandas(explode_chunks, "_row string, _no int, _at bigint, _chunk string, _end boolean")
        .repartition("_row", "_no")
        .mapInPandas(boundaries, "_row string, _no int, _head array<bigint>, _tail array<bigint>")
    )
    # each chunk's tail goes to the next one's head; every chunk is scanned once
    none = F.lit(None).cast("array<bigint>")
    ends = F.array(F.struct((F.col("_no") + 1).alias("n"), F.col("_tail").alias("t"), none.alias("h")), F.struct(F.col("_no").alias("n"), none.alias("t"), F.col("_head").alias("h")))
    both = marks.select("_row", F.explode(ends).alias("_e")).groupBy("_row", F.col("_e.n").alias("_no")).agg(F.max("_e.t").alias("_tail"), F.max("_e.h").alias("_head"))
    # Matching a pre-token depends only on what follows its start, so from a common boundary on two scans
    # agree.  A chunk is trusted if the one before it is and both share a boundary: the cuts up to the first
    # gap count, and what lies behind it is one piece.
    met = both.select("_row", "_no", F.array_min(F.array_intersect("_tail", "_head")).alias("_at")).where("_at is not null")
    cuts = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_no", "_at"))).alias("_c"))
    cuts = cuts.select("_row", F.expr("transform(filter(_c, (x, i) -> x._no = i + 1), x -> x._at)").alias("_cuts"))
    joined = keyed.join(cuts, "_row", "left")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, key, text, times, at in zip(batch["_row"], batch["_id"], batch["_text"], batch["_n"], batch["_cuts"]):
                ends = [0, *([] if at is None else [int(x) for x in at]), len(text)]
                parts = [text[a:b] for a, b in zip(ends, ends[1:])]
                for t in range(int(times)):
                    for no, part in enumerate(parts):
                        yield pd.DataFrame({"_row": [f"{row}:{t}"], "_id": [key], "_no": [no], "_piece": [part]})

    return joined.mapInPandas(take, f"_row string, _id {kind}, _no int, _piece string").repartition("_row", "_no")


def decode_corpus(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = TOKENIZER_DIR, name: str = VOCABULARY
) -> DataFrame:
    """Texts of token ids: the raw bytes of all ids joined, then read as UTF-8.

    An empty or null list gives an empty text.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_encoding(folder, name)
        for batch in batches:
            texts = ["" if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8") for x in batch[ids_col]]
            yield pd.DataFrame({id_col: batch[id_col], "text": texts})

    return df.select(id_col, ids_col).mapInPandas(back, f"`{id_col}` {kind}, text string")


def count_tokens(
    df: DataFrame,
    keep: list[str],
    text_col: str = "text",
    folder: str = TOKENIZER_DIR,
    name: str = VOCABULARY,
    out_col: str = "n_tokens",
) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text (0 if null or empty)."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoding(folder, name).encode_ordinary
        for batch in batches:
            out = batch[keep].copy()
            out[out_col] = [len(encode(t)) if t else 0 for t in batch["_text"]]
            yield out

    return df.select(*keep, F.col(text_col).alias("_text")).mapInPandas(count, f"{fields}, `{out_col}` bigint")
