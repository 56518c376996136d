import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.split import bisect_text, split_oversized

SCHEMA = "chunk_id string, content string, start_line int, end_line int, indexed_at timestamp, piece_no string, _text int"


def check(text, limit, overlap):
    pieces = bisect_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - overlap <= c <= b < d
    assert all(0 < b - a <= limit for a, b in pieces)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r}é漢", min_size=31, max_size=400), st.sampled_from([(30, 5), (30, 0), (25, 20), (40, 10)]))
def test_pieces_cover_and_fit(text, sizes):
    check(text, *sizes)


def test_cuts_at_the_strongest_boundary():
    text = "x" * 45 + "\n\n" + "y" * 30 + "\n" + "z" * 30
    assert bisect_text(text, 80, 0)[0] == (0, 47)
    pieces = check("".join(f"line {i}\n" for i in range(3000)), 8000, 800)
    text = "".join(f"line {i}\n" for i in range(3000))
    assert all(a == 0 or text[a - 1] == "\n" for a, _ in pieces)


def test_no_boundary_and_exact_sizes():
    assert check("a" * 16000, 8000, 800)[0][0] == 0
    assert bisect_text("a" * 8000, 8000, 800) == [(0, 4000), (3200, 8000)]


def test_operator_cases(spark):
    text = "".join(f"row {i} of the text\n" for i in range(40))
    rows = [
        ("a", text, 5, 45, None, "x", 1),
        ("a", text, 5, 45, None, "x", 1),  # repeated
        ("b", text, 45, 5, None, None, None),  # swapped lines
        ("c", text, None, 50, None, None, None),
        ("d", text, None, None, None, None, None),
        ("e", None, 1, 1, None, None, None),
        ("f", "", 1, 1, None, None, None),
        ("g", "short", 1, 1, None, None, None),
        (None, text, 1, 41, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = split_oversized(df, limit=200, overlap=20).collect()
    by = {}
    for r in out:
        by.setdefault(r["chunk_id"], []).append(r)
    assert set(by) == {"a", "b", "c", "d", None}
    starts = {"a": 5, "b": 5, "c": 10, "d": 1, None: 1}
    for key, pieces in by.items():
        pieces.sort(key=lambda r: r["piece_no"])
        assert [p["piece_no"] for p in pieces] == list(range(pieces[0]["n_pieces"]))
        for p in pieces:
            assert p["content"] == text[p["char_start"] : p["char_end"]] and len(p["content"]) <= 200
            assert p["start_line"] == starts[key] + text[: p["char_start"]].count("\n")
            assert p["end_line"] == starts[key] + text[: p["char_end"]].rstrip("\n").count("\n") + (p["char_end"] == len(text))
    assert split_oversized(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, text + x, 1, 41, None, None, None) for x in "aab"], SCHEMA)  # one text twice
    assert split_oversized(nulls, limit=200, overlap=20).where("piece_no = 0").count() == 2
    with pytest.raises(ValueError):
        split_oversized(df, limit=10, overlap=10)


def test_very_long_text(spark):
    text = "word " * 200_000
    out = split_oversized(spark.createDataFrame([("a", text)], "chunk_id string, content string"), start_line_col=None, end_line_col=None, order_col=None)
    r = out.orderBy("piece_no").collect()
    assert len(r) > 120 and r[-1]["char_end"] == len(text) and max(len(x["content"]) for x in r) <= 8000


def test_signs_of_several_code_points_stay_whole():
    for sign in ("e\u0301\u0323", "\U0001f469\u200d\U0001f4bb", "\U0001f44d\U0001f3fd", "\r\n", "\u0915\u094d\u0937"):
        text = sign * 60
        for a, b in check(text, 30, 6):
            assert a % len(sign) == 0 and (b % len(sign) == 0 or b == len(text)), (sign, a, b)
