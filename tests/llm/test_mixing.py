from hypothesis import given
from hypothesis import strategies as st

from loomwork.llm.mixing import mix_sources, water_fill

DOCS = "doc_id bigint, source string, n_tokens bigint, repeats string"
TARGETS = "source string, target_share double, max_repeats int"


@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.integers(0, 5)), min_size=1, max_size=8), st.floats(1, 10000))
def test_water_fill(sources, total):
    sizes = {str(i): s for i, (s, _, _) in enumerate(sources)}
    targets = {str(i): w for i, (_, w, _) in enumerate(sources)}
    repeats = {str(i): m for i, (_, _, m) in enumerate(sources)}
    got, give = water_fill(sizes, targets, repeats, total)
    caps = {s: sizes[s] * repeats[s] for s in sizes}
    assert all(v <= caps[s] * (1 + 1e-9) for s, v in give.items())
    assert abs(sum(give.values()) - got) < 1e-6 * max(1, got)
    assert abs(got - min(total, sum(caps.values()))) < 1e-6 * max(1, got)
    free = [give[s] / targets[s] for s in give if give[s] < caps[s] * (1 - 1e-9)]
    assert not free or max(free) - min(free) < 1e-6 * max(free)  # unclamped sources keep their proportions


def test_mix(spark):
    docs = [(i, "hot", 10 + i % 7, "x") for i in range(6000)] + [(10_000 + i, "b", 20, None) for i in range(300)] + [(20_000 + i, "tiny", 5, None) for i in range(10)]
    docs += [(30_000, None, 5, None), (30_001, "untold", 5, None), (30_002, "b", None, None), (30_003, "b", 0, None)]
    targets = [("hot", 0.5, 1), ("b", 0.3, 8), ("tiny", 0.1, 3), ("gone", 0.1, 2), (None, 0.1, 1), ("b", 0.1, 8)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    mix, shares = mix_sources(d, t, total=60_000)
    rows = mix.collect()
    most = {"hot": 1, "b": 8, "tiny": 3}
    assert all(1 <= r["repeats"] <= most[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    by = {r["source"]: r for r in shares.collect()}
    assert set(by) == {"hot", "b", "tiny", "gone"} and by["gone"]["actual"] == 0
    assert by["tiny"]["actual"] == 150 and by["tiny"]["clamped"]
    assert abs(sum(r["actual_share"] for r in by.values()) - 1) < 1e-9
    for s in ("hot", "b"):
        assert abs(by[s]["actual"] - by[s]["wanted"]) <= 20
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mix_sources(d, t, total=60_000)[0].collect()))  # seeded
    other = mix_sources(d, t, total=60_000, seed=3)[0]
    assert {r["doc_id"] for r in other.collect()} != {r["doc_id"] for r in rows}


def test_empty(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mix, shares = mix_sources(d, t)
    assert mix.count() == 0 and [r["actual"] for r in shares.collect()] == [0]
    mix, shares = mix_sources(d, t.limit(0))
    assert mix.count() == 0 and shares.count() == 0


def test_the_largest_mix_that_meets_all_targets():
    sizes, targets, repeats = {"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 3, "c": 1}
    total, give = water_fill(sizes, targets, repeats, exact=True)
    assert abs(total - 100) < 1e-9 and all(abs(give[s] - targets[s] * total) < 1e-9 for s in targets)
