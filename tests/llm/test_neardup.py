import random
import re
from collections import Counter

from loomwork.llm.neardup import duplicate_groups, near_duplicate_pairs, near_duplicates

SCHEMA = "rec_no bigint, content string, _key int"


def brute(texts, t=0.7, least=20):
    bags = {i: Counter(re.findall(r"\w+", (x or "").lower())) for i, x in texts.items()}
    bags = {i: b for i, b in bags.items() if sum(b.values()) >= least}
    ids = sorted(bags)
    out = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            either = sum((bags[a] | bags[b]).values())
            if sum((bags[a] & bags[b]).values()) >= t * either - 1e-9:
                out.add((a, b))
    return out


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(n):
        if i % 3 and out:
            words = re.findall(r"\w+", rng.choice(list(out.values())))
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]])
                words = words or ["x"]
            rng.shuffle(words)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 60))]
        out[i] = " ".join(words)
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        data = texts(random.Random(seed), 260)
        df = spark.createDataFrame([(i, x, 0) for i, x in data.items()], SCHEMA)
        links, members = near_duplicates(df)
        got = [tuple(r) for r in near_duplicate_pairs(links, members).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(data)
        want = {}

        def find(x, want=want):
            while want.setdefault(x, x) != x:
                x = want[x]
            return x

        for a, b in got:
            a, b = find(a), find(b)
            want[max(a, b)] = min(a, b)
        for r in duplicate_groups(links, members).collect():
            assert r["group_id"] == find(r["id"])


def test_copies_ties_and_dirty_rows(spark):
    base = " ".join(f"a{i}" for i in range(20))
    rows = [(i, base, 0) for i in range(100)]  # a hot group of copies
    rows += [(200, " ".join(f"a{i}" for i in range(14)) + " q r s t u v", 0)]  # 14 of 26: below
    rows += [(201, " ".join(f"a{i}" for i in range(17)) + " b c d", 0)]  # 17 of 23: above
    rows += [(202, None, 0), (203, "", 0), (204, "too few words", 0), (None, base, 0), (5, base, 1), (205, base.upper() + " \u200b\r\n", 0)]
    links, members = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    pairs = {tuple(r) for r in near_duplicate_pairs(links, members).collect()}
    assert {(0, i) for i in [*range(1, 100), 205, 201]} == pairs  # a star beyond 64 copies
    groups = {r["id"]: (r["group_id"], r["n_copies"]) for r in duplicate_groups(links, members).collect()}
    assert groups[205] == (0, 101) and groups[201] == (0, 1) and groups[200] == (200, 1)
    links, members = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert near_duplicate_pairs(links, members).count() == 0


def test_exactly_at_the_threshold(spark):
    a = " ".join(f"a{i}" for i in range(20))
    b = " ".join(f"a{i}" for i in range(14))  # 14 words: too short
    c = " ".join(f"a{i}" for i in range(20)) + " " + " ".join(f"b{i}" for i in range(8))  # 20 of 28
    d = " ".join(f"a{i}" for i in range(20)) + " " + " ".join(f"c{i}" for i in range(9))  # 20 of 29
    links, members = near_duplicates(spark.createDataFrame([(1, a, 0), (2, b, 0), (3, c, 0), (4, d, 0)], SCHEMA))
    got = {tuple(r) for r in near_duplicate_pairs(links, members).collect()}
    assert got == brute({1: a, 2: b, 3: c, 4: d})
    assert (1, 3) in got and (1, 4) not in got


def test_large_classes_of_different_texts(spark):
    rng = random.Random(5)
    data = {}
    for i in range(140):  # two linked classes of 70 orders each
        words = [f"a{n}" for n in range(25)] + (["b"] if i % 2 else [])
        rng.shuffle(words)
        data[i] = " ".join(words)
    links, members = near_duplicates(spark.createDataFrame([(i, x, 0) for i, x in data.items()], SCHEMA))
    got = [tuple(r) for r in near_duplicate_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
