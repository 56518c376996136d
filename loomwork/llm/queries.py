"""Queries of the numbered problems, over whole tables, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .docpairs import function_docs
from .handwritten import not_handwritten
from .mixing import mix_sources
from .neardup import duplicate_groups, near_duplicate_pairs, near_duplicates
from .neighbors import nearest, nearest_pairs
from .split import split_oversized
from .tokenize import count_tokens, encode_corpus
from .truncation import find_truncated, truncation_shares


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks longer than the limit, once each, as the splitter sees them."""
    pieces = split_oversized(table(spark, sf_dir, "chunks"))
    return pieces.where("piece_no = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place, lines and size."""
    pieces = split_oversized(table(spark, sf_dir, "chunks"))
    return pieces.select("chunk_id", "piece_no", "n_pieces", "char_start", "char_end", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions and methods."""
    return function_docs(table(spark, sf_dir, "chunks")).select("chunk_id", "symbol").distinct()


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their documentation."""
    return function_docs(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the 10 nearest of the other."""
    return nearest_pairs(nearest(table(spark, sf_dir, "records"), k=10))


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record its 10 most similar others."""
    return nearest(table(spark, sf_dir, "records"), k=10)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share 0.7 of their words."""
    return near_duplicate_pairs(*near_duplicates(table(spark, sf_dir, "records")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's group, class of copies and number of links."""
    links, members = near_duplicates(table(spark, sf_dir, "records"))
    return duplicate_groups(cut(links), cut(members))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of files nobody wrote by hand."""
    return not_handwritten(table(spark, sf_dir, "scan_results")).select("result_id")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file counts as not written by hand."""
    return not_handwritten(table(spark, sf_dir, "scan_results"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids by overlapping chunks of 512 characters, which nearly all texts are longer than."""
    return encode_corpus(table(spark, sf_dir, "documents"), chunk_chars=512, overlap_chars=128)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return mix_sources(sized, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text breaks off."""
    return find_truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share of texts that break off."""
    docs = table(spark, sf_dir, "documents")
    return truncation_shares(docs, find_truncated(docs).select("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_pairs, p3_found, p3_nearest, p4_found, p4_groups,
        p5_found, p5_reasons, p6_ids, p6_chunked, p7_mix, p7_shares, p8_found, p8_shares,
    )
}

#: Only the first problem's finding can be told in SQL; the others are tested
#: against brute force, exact round trips or planted cases in tests/llm.
ORACLE: dict[str, str] = {
    "p1_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 8000",
}
