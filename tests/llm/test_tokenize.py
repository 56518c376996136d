import random

import pytest

from loomwork.llm.tokenize import count_tokens, decode_corpus, encode_corpus, load_encoding

SCHEMA = "doc_id bigint, text string, ids int"
try:
    ENCODING = load_encoding()
except OSError:
    ENCODING = None
pytestmark = pytest.mark.skipif(ENCODING is None, reason="no vocabulary files")


def samples():
    rng = random.Random(2)
    parts = ["word ", "  \n\n", "x" * 60, "éß漢字", "👩‍💻", "12345", "don't ", "\t", " ", "<|endoftext|>", "!!!", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(120)]


def test_chunked_equals_whole(spark):
    rows = [(i, t, 1) for i, t in enumerate(samples())]
    rows += [(900, None, 1), (901, "", 1), (902, " " * 500, 1), (903, "a" * 700, 1), (904, "\n" * 333 + "b", 1), (0, rows[0][1], 2), (905, "ab " * 100 + "c", 1), (905, "ab " * 100 + "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk, overlap in ((40, 20), (64, 64), (7, 3)):
        got = sorted((r["doc_id"], list(r["ids"])) for r in encode_corpus(df, chunk_chars=chunk, overlap_chars=overlap).collect())
        assert got == sorted((i, ENCODING.encode_ordinary(t) if t else []) for i, t, _ in rows)


def test_round_trip_and_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(samples())] + [(900, None, 1), (901, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    back = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    sizes = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()}
    assert sizes == {i: len(ENCODING.encode_ordinary(t)) if t else 0 for i, t, _ in rows}
    assert encode_corpus(df.limit(0)).count() == 0
