import math

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import fusion, lexical, vector

DOCS = [("doc1", "func handleSearch query vector embedding"), ("doc2", "func handleIndex project files scanner"), ("doc3", "vector embedding search semantic similarity")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "id string, text string")


def best(spark, rows, query, k=10):
    return [r["id"] for r in lexical.top(lexical.bm25(docs(spark, rows), "id", "text", query), "id", k).collect()]


def test_bm25_vectors(spark):
    assert best(spark, DOCS, "vector search")[0] == "doc3"
    assert best(spark, [], "x") == [] and best(spark, DOCS, "absent") == [] and best(spark, DOCS, "vector", 0) == [] and best(spark, DOCS, "  ") == []
    assert len(best(spark, [(f"d{i:02}", "same words here") for i in range(20)], "words", 5)) == 5
    for word in ("search", "target", "symbol", "server"):
        assert best(spark, [("a", "func handleSearchQuery target_symbol HTTPServer2")], word) == ["a"]


def test_bm25_formula_and_repeated_terms(spark):
    got = {r["id"]: r["score"] for r in lexical.bm25(docs(spark), "id", "text", "vector vector").collect()}
    dl, avg = {"doc1": 7, "doc2": 7, "doc3": 5}, 19 / 3
    idf = math.log((3 - 2 + 0.5) / 2.5 + 1)
    for i in ("doc1", "doc3"):
        assert abs(got[i] - 2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl[i] / avg))) < 1e-6
    assert set(got) == {"doc1", "doc3"}


def test_filter_comes_after_the_over_fetch(spark):
    rows = [(f"d{i}", "alpha " * (9 - i), "x" if i < 8 else "y") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, text string, p string")
    assert lexical.lexical_search(df, "id", "text", "alpha", 2, F.col("p") == "y").count() == 0
    assert lexical.lexical_search(df, "id", "text", "alpha", 3, F.col("p") == "y").count() == 1


def test_document_text(spark):
    df = spark.createDataFrame([(" body ", "n", None, '["a", "b"]', "not json"), (None, "", "p", "[]", "null")], "c string, n string, p string, s string, k string")
    got = [r[0] for r in df.select(lexical.document_text(*map(F.col, "cnpsk"))).collect()]
    assert got == ["body n a b not json", "p [] null"]


def test_vector_search(spark):
    rows = [(1, [1.0, 0.0], 1.0), (2, [1.0, 1.0], 9.0), (3, [0.0, 2.0], 1.0), (4, [0.0, 0.0], 1.0), (5, None, 1.0), (6, [1.0], 1.0), (7, [float("nan"), 1.0], 1.0), (8, [2.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>, p double")
    got = vector.search(df, "id", "v", [1.0, 0.0], 3, 2, F.col("p")).collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(2, 0.707107), (1, 1.0), (8, 1.0)]
    assert [r["id"] for r in vector.search(df, "id", "v", [1.0, 0.0], 2, 2, F.col("p")).collect()] == [1, 8]
    assert [r["id"] for r in vector.search(df, "id", "v", [1.0, 0.0], 2, 2, F.col("p"), boost_first=True).collect()] == [2, 1]
    assert vector.search(df, "id", "v", [1.0, 0.0], 0, 2).count() == 0
    unit = df.where("id = 2").select(vector.l2_normalize(F.col("v")), vector.matryoshka(F.col("v"), 1)).first()
    assert abs(unit[0][0] - math.sqrt(0.5)) < 1e-9 and unit[1] == [1.0]


def test_nearest_of_queries(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = {}
    for r in vector.nearest_of_queries(df, df.where("id % 10 = 0"), "id", "v", 6, 4, part_rows=7).collect():
        got.setdefault(r["query"], set()).add(r["neighbor"])
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    assert got == {q: set(np.lexsort((np.arange(200), -s[q]))[:4].tolist()) for q in range(0, 200, 10)}


def test_fusion(spark):
    v = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.8, 0.8)], "id int, similarity double, boosted double")
    x = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id int, score double")
    plain = {r["id"]: r["rrf"] for r in fusion.rrf(v, x, "id", "plain words").collect()}
    assert abs(plain[2] - (1 / 62 + 1 / 61)) < 1e-12 and plain[1] == 1 / 61 and plain[3] == 1 / 62
    code = {r["id"]: r["rrf"] for r in fusion.rrf(v, x, "id", "someName").collect()}
    assert abs(code[3] - 1.5 / 62) < 1e-12
    now = 1_700_000_000
    rows = [(1, 1.0, "document", None, None, str(now - 14 * 86400)), (2, 1.0, "code", "1.3", "2", str(now)), (3, 1.0, "document", "bad", "", "soon"), (4, 1.0, "document", None, None, str(now + 99))]
    df = spark.createDataFrame(rows, "id int, rrf double, c string, f string, p string, u string")
    got = {r["id"]: r["score"] for r in fusion.boosted(df, *map(F.col, "cfpu"), now).collect()}
    assert got == {1: 1.25, 2: 2.59999990, 3: 1.0, 4: 1.5}


def test_budgets_and_cuts(spark):
    rows = [("g", i, "w " * n, i) for i, n in enumerate([3, 9, 3, 2, 9])]
    df = spark.createDataFrame(rows, "g string, id int, t string, r int")
    assert [r["id"] for r in fusion.budget_prefix(df, "t", [F.asc("r")], 17).orderBy("id").collect()] == [0, 1]
    greedy = fusion.budget_greedy(df, "id", "t", "r", 10, "g").first()
    assert (greedy["taken"], greedy["skipped"], greedy["used"]) == ([0, 2, 3], [1, 4], 10)
    scores = [0.9, 0.88, 0.86, 0.85, 0.84, 0.83, 0.82, 0.5, 0.49]
    hits = spark.createDataFrame(list(enumerate(scores)), "id int, s double")
    assert fusion.adaptive_cut(hits, "id", "s").count() == 7
    assert fusion.adaptive_cut(hits.where("id < 3"), "id", "s").count() == 3
