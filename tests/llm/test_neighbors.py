import numpy as np

from loomwork.llm.neighbors import lay_blocks, multi_sequence, nearest, nearest_pairs


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -s[r]))[:k]] for r, i in enumerate(ids)}


def found(df, **kw):
    out = {}
    for r in nearest(df, **kw).orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["neighbor"])
    return out


def frame(spark, vectors, extra=()):
    rows = [(int(i), [float(x) for x in v], 1) for i, v in vectors.items()] + list(extra)
    return spark.createDataFrame(rows, "rec_no bigint, embedding array<float>, _raw int")


def test_exact_with_all_candidates(spark):
    rng = np.random.default_rng(3)
    vectors = {i * 7: rng.normal(size=8) for i in range(300)}
    for i in range(40):  # copies, and copies of another length
        vectors[5001 + i] = vectors[0]
        vectors[6001 + i] = vectors[7 * i] * (2 if i % 2 else 1)
    got = found(frame(spark, vectors), dim=8, k=5, candidates=10_000)
    assert got == brute(vectors, 5)


def test_recall_with_few_candidates(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    vectors = {i: centers[i % 40] + 0.4 * rng.normal(size=16) for i in range(4000)}
    got, true = found(frame(spark, vectors), dim=16, k=10, candidates=400), brute(vectors, 10)
    assert set(got) == set(true)
    assert np.mean([len(set(got[i]) & set(true[i])) / 10 for i in true]) >= 0.9


def test_dirty_rows(spark):
    ok = {1: [1, 0, 0, 0], 2: [0.9, 0.1, 0, 0], 3: [0, 1, 0, 0]}
    bad = [(4, None, 1), (5, [1.0, 2.0], 1), (6, [0.0] * 4, 1), (7, [float("nan"), 1.0, 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0, 1.0], 1), (9, [None, 1.0, 1.0, 1.0], 1), (None, [1.0] * 4, 1), (2, [0.9, 0.1, 0.0, 0.0], 2)]
    df = frame(spark, ok, bad)
    got = found(df, dim=4, k=10)
    assert got == {1: [2, 3], 2: [1, 3], 3: [2, 1]}
    pairs = {tuple(r) for r in nearest_pairs(nearest(df, dim=4, k=1)).collect()}
    assert pairs == {(1, 2), (2, 3)}
    assert nearest(df.limit(0), dim=4).count() == 0
    asked = spark.createDataFrame([(3,)], "rec_no bigint")
    assert found(df, dim=4, k=1, queries=asked) == {3: [2]}


def test_cells_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    d1, d2, counts = rng.random(6), rng.random(7), rng.integers(0, 4, (6, 7))
    cells = multi_sequence(d1, d2, counts, int(counts.sum()))
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == int((counts > 0).sum())


def test_blocks_are_bounded():
    counts = np.array([[3, 50, 4], [1, 1, 1]])
    first, width = lay_blocks(counts, rows=10)
    assert width[0, 1] == 5 and first[1, 0] == first[1, 2]
    load = {}
    for c, n in np.ndenumerate(counts):
        for w in range(width[c]):
            load[first[c] + w] = load.get(first[c] + w, 0) + n / width[c]
    assert max(load.values()) <= 10
