from loomwork.llm.truncation import find_truncated, truncation_shares

SCHEMA = "doc_id bigint, text string, source string, doc_type string, evidence int, _whole int"
FULL = "The reader keeps one row per glob. It took 4 minutes to trace the last sample back to the edge."


def run(spark, rows):
    df = spark.createDataFrame([(i, t, s, k, 1, 1) for i, t, s, k in rows], SCHEMA)
    return df, {r["doc_id"]: r["evidence"] for r in find_truncated(df).collect()}


def test_planted_cases(spark):
    rows = [
        (1, FULL, "a", "summary"), (2, FULL[:-9], "a", "summary"), (3, FULL[:-9] + " [more]", "a", "review"),
        (4, None, "a", "summary"), (5, " \t\r\n", "a", "summary"), (6, "link raw reader", "t", "todo"), (7, "fix(core): bind the reader in scope", "c", "commit"),
        (8, "fix(core): bind the reader in scope  The reader keeps one row per gl", "c", "commit"), (9, "# Title\n\nText here.\n\n- pinned schema\n- outer symbol", "m", "markdown"),
        (10, '{"name": "y", "items": [{"a": "b"}]}', "j", "tool"), (11, '{"name": "x", "items": [{"a": "b', "j", "tool"), (12, "<html><body><p>Well. &amp; so.</p></body></html>", "w", "page"),
        (13, "<html><body><p>Well. &amp; so.</p>\n<p>Not", "w", "page"), (14, "func a() {\n\treturn nil\n}\n", "g", "go"), (15, "func a() {\n\tif x := b(", "g", "go"),
        (16, "Keeps one row per glob...", "n", "note"), (17, "Text.\n\n```go\nx := 1\n```\n\nThe end.", "m", "markdown"), (18, "Text.\n\n```go\nx := 1;", "m", "markdown"),
        (19, "Fin de la phrase complète !", None, "note"), (20, "Die Prüfung dauert rund 4 Sek", None, "note"), (21, "def a(b):\n    return b\n", "g", "python"), (22, "def a(b):\n    x = call(b", "g", "python"),
        (2, FULL[:-9], "a", "summary"),
    ]
    df, got = run(spark, rows)
    assert set(got) == {2, 3, 8, 11, 13, 15, 18, 20, 22}
    assert got[3] == "mark" and got[11] == "structure" and got[2] == "copy" and got[20] == "sentence"
    shares = {r["source"]: r["truncated_share"] for r in truncation_shares(df, find_truncated(df)).collect()}
    assert shares["t"] == 0 and shares[None] == 0.5


def test_copies_of_longer_texts(spark):
    long = " ".join(f"{FULL} Part {i}." for i in range(60))
    rows = [(1, long, "a", "page")] + [(10 + n, long[:n], "a", "page") for n in (33, 64, 65, 700, 2047, 2048)]
    rows += [(100 + n, long[: 5 * n] + "#", "a", "page") for n in range(20, 40)]  # no prefixes of it
    df, _ = run(spark, rows)
    got = {r["doc_id"]: r["longer"] for r in find_truncated(df).collect()}
    want = {10 + n for n in (33, 64, 65, 700, 2047, 2048) if long[:n].rstrip()[-1] not in ".!?"}
    assert {i for i, n in got.items() if n == len(long)} == want and want


def test_a_limit_with_dots(spark):
    words = [f"stone{i} and bridge{i} wait here today" for i in range(40)]
    whole = [(i, f"{w}. The lamp is out{'.' if i % 2 else '...'}", "r", "review") for i, w in enumerate(words)]
    cut = [(100 + i, ("The river runs past the lamp " * 20)[: 290 - i % 3].rstrip() + "...", "r", "review") for i in range(30)]
    _, got = run(spark, whole + cut)
    assert set(got) == {100 + i for i in range(30)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert find_truncated(df).count() == 0 and truncation_shares(df, find_truncated(df)).count() == 0


def test_marked_texts_with_their_copy(spark):
    words = [(i, f"The lamp stands beside the edge. Row {i} is whole.", "a", "note") for i in range(3)]  # "edge" ends sentences elsewhere
    long = "It took 4 minutes to trace the sample to the edge of the third ring. It is done."
    cut = long[: long.index("edge") + 4]
    rows = words + [(10, long, "a", "note"), (11, cut + "...", "a", "note"), (12, cut + "\u2026 ", "a", "note"), (13, cut + " [more]", "a", "note")]
    rows += [(14, "Nobody walks past the old edge...", "a", "note"), (15, "Nobody walks past the old edge....  ", "a", "note")]  # no copy goes on
    _, got = run(spark, rows)
    assert got == {11: "copy", 12: "copy", 13: "mark"}


def test_todos_subjects_and_rates(spark):
    filler = [(i, f"The spare lamp waits here. Nobody moves the lamp beside stone {i}. It is late.", "a", "note") for i in range(60)]
    once = [(70, "Wait for the beside. Then go.", "a", "note")]  # one of 61 ends a sentence
    rows = [
        (80, "link the raw reader package", "t", "todo"), (81, "link the raw reader pack", "t", "todo"), (82, "link the raw reader", "t", "todo"),
        (83, "collect the lamps that stand besi...", "t", "todo"), (84, "fix(core): " + "bind the reader in scope and " * 20, "c", "commit"),
        (85, "The reader sleeps on the far side of the bench beside...", "n", "note"),
    ]
    _, got = run(spark, filler + once + rows)
    assert got == {81: "copy", 83: "sentence", 85: "sentence"}


def test_a_limit_between_two_windows(spark):
    words = [(i, f"stone{i} waits. The lamp is out.", "r", "review") for i in range(40)]
    cut = [(100 + i, ("The river runs past the lamp that is out " * 30)[: 286 + i % 6].rstrip() + "...", "r", "review") for i in range(30)]
    ends = sorted({t[1].rstrip(".").split()[-1] for t in cut})
    pauses = [(900 + k, f"Then {w} again. We waited for the {w}. The {w}.", "x", "note") for k, w in enumerate(ends)]
    _, got = run(spark, words + cut + pauses)
    assert set(got) == {c[0] for c in cut}
