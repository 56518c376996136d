import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm.handwritten import Shingles, bands, file_content, header_comments, not_handwritten, parities

SCHEMA = "result_id bigint, project_id string, rel_path string, records array<struct<id:string,content:string>>, reason int, _label string"


def getters(rng, mark=""):
    body = "".join(f"func (x *T{rng.randint(1, 999)}) Get{rng.choice('ABCDEF')}{i}() int32 {{\n\tif x != nil {{\n\t\treturn x.f{rng.randint(1, 99)}\n\t}}\n\treturn 0\n}}\n" for i in range(rng.randint(6, 14)))
    return f"{mark}package a\n\n{body}"


def hand(rng):
    verbs = ["if a%d > %d {\n\trun(a%d, b[%d])\n}\n", "for i := 0; i < n%d; i++ {\n\tout = append(out, f%d(i, %d, c%d))\n}\n", "x%d := map[string]int{\"k\": %d, \"z\": y%d[%d]}\n", "switch v%d.(type) {\ncase T%d:\n\treturn q%d(%d)\n}\n", "go w%d(<-ch%d, %d)\ndefer mu%d.Unlock()\n"]
    return "package b\n\nfunc Run() error {\n" + "".join(rng.choice(verbs) % tuple(rng.randint(1, 99) for _ in range(4)) for _ in range(25)) + "return nil\n}\n"


def one(i, path, text, project="p"):
    return (i, project, path, None if text is None else [(f"chunk:p:{path}:{k}", text[k * 400 : k * 400 + 400]) for k in reversed(range(len(text) // 400 + 1))], 1, "x")


def test_planted_cases(spark):
    rng = random.Random(4)
    mark = "// Code generated by protogen. DO NOT EDIT.\n\n"
    rows = [one(i, f"a/f{i}.go", getters(rng, mark if i < 4 else "")) for i in range(8)]  # 4-7: by their family
    rows += [one(20 + i, f"b/h{i}.go", hand(rng)) for i in range(12)]
    rows += [
        one(40, "c/node_modules/x/a.js", None), one(41, "c/vendor_form/a.go", hand(rng)), one(42, "c/x.min.js", None), one(43, "c/x_minify.go", hand(rng)),
        one(44, "c/a.js", "!function(e,t){" + "".join(f"var a{i}=b({i});for(var k=0;k<c.length;k++)d+=c[k];" for i in range(80)) + "}()"),
        one(45, "c/d.go", "package t\n\nvar x = []byte{" + ",".join(f"0x{i:02x}" for i in range(200)) + "}\n"),
        one(46, "c/e.ts", "/*!\n * lib v1.2.3\n * (c) 2020 the lib contributors\n */\n" + hand(rng)), one(47, "c/f.ts", hand(rng) + "\n// the header line \"DO NOT EDIT\" is written below\n"),
        one(48, None, None), one(49, "c/lib-2.0.1/q.go", hand(rng)), (50, None, "c/g.go", [None, ("x", None)], 1, None), one(44, "c/a.js", "!function(e,t){" + "var a=b;" * 200 + "}()"),
    ]
    copied = hand(rng)
    rows += [one(60, "z/own.go", copied, "p"), one(61, "y/other.go", copied.replace("\n", "\r\n"), "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["result_id"]: (r["reason"], r["evidence"]) for r in not_handwritten(df).collect()}
    want = {i: ("generated", "own") for i in range(4)} | {i: ("generated", "family") for i in range(4, 8)}
    want |= {40: ("vendored", "own"), 42: ("minified", "own"), 44: ("minified", "own"), 45: ("data", "own"), 46: ("vendored", "own"), 49: ("vendored", "own")}
    want |= {60: ("vendored", "family"), 61: ("vendored", "family")}
    assert got == want
    assert not_handwritten(df.limit(0)).count() == 0


def test_pieces_in_order(spark):
    df = spark.createDataFrame([(1, "p", "a", [("x:10", "c"), ("x:2", "b"), ("x:0", "a"), None, ("x:3", None)], 1, ""), (2, "p", "a", None, 1, "")], SCHEMA)
    assert [r[0] for r in df.orderBy("result_id").select(file_content(F.col("records"))).collect()] == ["abc", None]


def test_header():
    assert "one" in header_comments("// one\n/*\n two\n*/\ncode\n// three") and "three" not in header_comments("// one\ncode\n// three")


def test_families_of_their_own_and_changed_copies(spark):
    rng = random.Random(9)
    rows = [one(i, f"a/f{i}.go", getters(rng)) for i in range(5)]  # no mark anywhere, one repository
    rows += [one(20 + i, f"b/h{i}.go", hand(rng)) for i in range(6)]
    library = hand(rng)
    rows += [one(40, "z/own.go", library, "p"), one(41, "y/other.go", library.replace("func Run()", "func Start()"), "q"), one(42, "b/vendor/l/l.go", hand(random.Random(3)), "p")]
    rows += [one(43, "b/l.go", hand(random.Random(3)).replace("nil", "nul"), "p")]
    got = {r["result_id"]: (r["reason"], r["evidence"]) for r in not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: ("generated", "family") for i in range(5)} | {i: ("vendored", "family") for i in (40, 41, 43)} | {42: ("vendored", "own")}
    assert got == want


def test_families_of_near_sets_and_chains(spark):
    rng = random.Random(2)
    words = [rng.choice("if for else return while break switch case func type match loop where".split()) for _ in range(900)]

    def text(a, b):
        return " ".join(words[a:b]) + "\n"

    # each 0.8 to the next one; the told one is at the chain's end
    chain = [text(k * 20, 300 + k * 20) for k in range(7)]
    mark = "// Code generated by protogen. DO NOT EDIT.\n\n"
    rows = [one(i, f"a/f{i}.go", (mark if i == 0 else "") + t) for i, t in enumerate(chain)]
    assert {r["result_id"] for r in not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    # told at both ends: the file between is near to either
    rows = [one(i, f"a/f{i}.go", (mark if i in (0, 2) else "") + t) for i, t in enumerate(chain[:3])]
    assert {r["result_id"] for r in not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 1, 2}


def test_header_behind_a_long_licence():
    licence = "/*\n" + " * of the licence\n" * 200 + " */\n\n"
    assert "DO NOT EDIT" in header_comments(licence + "// Code generated by x. DO NOT EDIT.\ncode\n")


def test_bands_are_independent():
    rng = np.random.default_rng(1)
    met, keys = 0, 0
    for _ in range(60):
        both = rng.choice(1 << 31, 400, replace=False).astype(np.uint32)  # Jaccard of 0.5
        a, b = bands(np.sort(both[:300])), bands(np.sort(np.r_[both[:100], both[200:]]))
        met += sum(x == y for x, y in zip(a, b))
        keys += len(set(a))
    assert keys == 60 * 20 and 0.08 < met / (60 * 20) < 0.18  # 0.5 cubed


def test_clusters_alone(spark):
    rng = random.Random(9)
    mark = "// Code generated by protogen. DO NOT EDIT.\n\n"
    rows = [one(i, f"a/f{i}.gen.go", getters(rng, mark)) for i in range(4)] + [one(4, "a/f4.go", getters(rng) + "func Extra(a int, b string) bool { for a > 0 { a -= 1 }; return b == \"\" }\n")]
    rows += [one(20 + i, f"b/h{i}.go", hand(rng)) for i in range(6)]
    rows += [one(40 + i, f"c/d{i}.go", "package t\n\nvar x = []byte{" + ",".join(f"0x{rng.randint(0, 255):02x}" for _ in range(200)) + "}\n", f"r{i}") for i in range(2)]
    library = hand(rng)
    rows += [one(50, "z/own.go", library, "p"), one(51, "y/other.go", library.replace("func Run()", "func Start()"), "q")]
    got = {r["result_id"]: (r["reason"], r["evidence"]) for r in not_handwritten(spark.createDataFrame(rows, SCHEMA), features=False).collect()}
    want = {i: ("generated", "family") for i in range(4)} | {i: ("data", "family") for i in (40, 41)} | {i: ("vendored", "family") for i in (50, 51)}
    assert {k: v for k, v in got.items() if k != 4} == want and got.get(4, want[0]) == want[0]


KEYWORDS = "if for else return while break switch case func type match loop where".split()


def test_links_among_unlike_sets_of_the_same_bands(spark):
    rng = random.Random(6)
    words = [rng.choice(KEYWORDS) for _ in range(320)]
    rows = [one(0, "a/told.go", "// Code generated by protogen. DO NOT EDIT.\n\n" + " ".join(words[20:])), one(1, "a/near.go", " ".join(words[:300]))]
    # 0.6 to both and to each other: they meet in the bands, but are no links
    rows += [one(10 + i, f"b/h{i}.go", " ".join(words[20:245] + [rng.choice(KEYWORDS) for _ in range(70)])) for i in range(12)]
    assert {r["result_id"] for r in not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 1}


def test_links_by_brute_force(spark):
    rng = random.Random(12)
    rows, sets, told = [], [], []
    for family in range(8):
        words = [rng.choice(KEYWORDS) for _ in range(500)]
        share, step, size = rng.choice([0.2, 0.5, 0.8]), rng.choice([3, 8, 15]), rng.choice([5, 12, 40])
        for _ in range(size):
            at = rng.randrange(12) * step
            text = " ".join(words[at : at + 250] + rng.sample(KEYWORDS, 4))
            told.append(rng.random() < share)
            rows.append(one(len(rows), f"f{family}/{len(rows)}.go", ("// Code generated by protogen. DO NOT EDIT.\n" if told[-1] else "") + text))
            sets.append(set(Shingles(text).masked.tolist()))
    want = {i for i, t in enumerate(told) if t}
    like = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    assert len({frozenset(s) for s in sets}) == len(sets)
    for i in range(len(sets)):
        links = [(like[i][j], told[j]) for j in range(len(sets)) if j != i and like[i][j] >= 0.8]
        known = [s for s, t in links if t]
        if known and (len(known) * 2 > len(links) or len(known) * 2 == len(links) and max(known) > max(s for s, t in links if not t)):
            want.add(i)
    assert {r["result_id"] for r in not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for size, edit in ((100, 0), (100, 10), (400, 90), (3000, 700)):
        a = np.unique(rng.integers(0, 1 << 31, size)).astype(np.uint32)
        b = np.unique(np.r_[a[edit:], rng.integers(0, 1 << 31, edit)]).astype(np.uint32)
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(parities(a), parities(b))) <= len(np.setxor1d(a, b))
