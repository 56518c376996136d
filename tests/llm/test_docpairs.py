import itertools
import random

from loomwork.llm.docpairs import assign, find_functions, function_docs, informative, pair_chunk


def names(code, lang):
    return [f["name"] for f in find_functions(code, lang)]


def test_definitions_of_each_language():
    go = "package a\n\n// Opens it.\nfunc (s *Store) Open(ctx context.Context) error {\n\treturn run(1)\n}\nfunc main() {}\n"
    assert names(go, "go") == ["Open", "main"]
    ts = "export async function load(a: string): Promise<void> {\n  if (a) {\n    call(a);\n  }\n}\nexport const sum = (a, b) => {\n  return a;\n};\nclass A {\n  private run(x: number): void {\n  }\n}\nconst v = compute(3);\n"
    assert names(ts, "js") == ["load", "sum", "run"]
    py = 'async def fetch(a, b=1) -> X:\n    """Def inside(): no."""\n    return a\n\nclass B:\n    def put(self, x):\n        pass\n'
    assert names(py, "py") == ["fetch", "put"]
    php = "<?php\nclass C\n{\n    public static function make(array $x = []): self\n    {\n    }\n}\n"
    assert names(php, "php") == ["make"]
    rs = "pub(crate) async fn read_all(x: &str) -> Result<()> {\n}\nimpl X {\n    fn new() -> Self {\n    }\n}\n"
    assert names(rs, "rs") == ["read_all", "new"]


def test_trivial_documentation():
    for doc in ("", "None", "//", "// ----------", "// TODO", "# XXX: write docs", "// n/a", "/** @internal */", "/** {@inheritDoc} */", "// eslint-disable-next-line no-shadow",
                "#[inline]", "//go:noinline", "// Copyright (c) 2020 The X authors\n// SPDX-License-Identifier: X", '"""prune_cache."""', "// pruneCache prunes the cache.",
                "/**\n * @param cache\n * @return\n */", "// x := make(map[string]int, 1)", "// if a {\n//   b(c);\n// }", "TBD", "# type: ignore"):
        assert not informative(doc, "pruneCache" if "_" not in doc else "prune_cache", ["cache"]), doc
    for doc in ("Caller owns the quota.", "// Not safe while the path is open.", "# Amortised cost is one manifest read.", "// TODO: drop this once the old reader is gone. Until then it retries twice.",
                "// Met à jour la page de résumé puis relâche le verrou.", "/** @returns the sorted bundle fence of the day */", "// pruneCache drops what nobody read for a day."):
        assert informative(doc, "pruneCache", ["cache"]), doc


def test_pairs_of_a_chunk():
    code = "// Context: Store -> get\n# Reads the newest row under the lock.\n@cached\ndef get(self, key):\n    return key\n\ndef put(self, key):\n    \"\"\"Writes behind, so a crash may lose a second.\"\"\"\n    return 1\n\n# far away comment\n\ndef drop(self):\n    pass\n"
    got = {s: origin for s, _, origin, _ in pair_chunk(code, None, ["get"], "py")}
    assert got == {"get": "above", "put": "inside"}
    only_context = "// Context: Store -> get\nfunc (s *Store) Get() {\n}\n"
    assert pair_chunk(only_context, "// ===", ["Get"], "go") == []
    assert [x[2] for x in pair_chunk(only_context, "Blocks until the pool is loose.", ["Get"], "go")] == ["docstring"]


def test_assignment_is_the_best():
    rng = random.Random(5)
    for _ in range(300):
        d, f = rng.randint(1, 4), rng.randint(1, 4)
        links = [(i, j, rng.choice([0.5, 1.0, 2.5, 3.0, 4.25])) for i in range(d) for j in range(f) if rng.random() < 0.6]
        weight = {(i, j): w for i, j, w in links}
        got = assign(d, links)
        assert len(set(got.values())) == len(got)
        best = 0.0
        for pick in itertools.product([None, *range(f)], repeat=d):
            used = [p for p in pick if p is not None]
            if len(used) == len(set(used)) and all(p is None or (i, p) in weight for i, p in enumerate(pick)):
                best = max(best, sum(weight[i, p] for i, p in enumerate(pick) if p is not None))
        assert abs(sum(weight[i, j] for i, j in got.items()) - best) < 1e-9


def test_operator_cases(spark):
    schema = "chunk_id string, rel_path string, content string, docstring string, symbols array<string>, symbol int"
    code = "\ufeff// Waits for the writer to end.\r\nfunc Wait() {\r\n}\r\n"
    rows = [
        ("a", "x/y.go", code, None, None, 1), ("a", "x/y.go", code, None, None, 2), ("b", "x/y.md", code, None, None, 1), ("c", None, code, None, [], 1),
        ("d", "x/y.go", None, "Holds the lock for a second.", ["Wait", None], 1), ("e", "x/y.go", "", "d", [], 1), ("f", "x/z.go", "func Wait() {}\n" + "x := 1\n" * 20000, "Holds the lock for a second.", [None], 1),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["chunk_id"], r["symbol"], r["origin"]) for r in function_docs(df).collect())
    assert got == [("a", "Wait", "above"), ("f", "Wait", "docstring")]
    assert function_docs(df.limit(0)).count() == 0


def test_methods_with_many_parameter_lines():
    params = "".join(f"    part{i}: string, // the {i}th (of many\n" for i in range(30))
    text = f"class A {{\n  build(\n{params}  ): Record<string, number> {{\n    return go(\n{params}    );\n  }}\n}}\n"
    assert [f["name"] for f in find_functions(text, "js")] == ["build"]


def test_parameters_over_several_lines_and_late_licences():
    code = "func Bind(\n\tctx context.Context, // who asks\n\tstore map[string]int,\n) error {\n\treturn nil\n}\n"
    assert find_functions(code, "go")[0]["params"] == ["ctx", "store"]
    code = "function bind(\n  a,\n  cb: (x: number) => void,\n  opts = { deep: f(1, 2) },\n) {\n  return a;\n}\n"
    assert find_functions(code, "js")[0]["params"] == ["a", "cb", "opts"]
    # repeats the parameters alone
    assert not informative("// Bind ctx store", "Bind", ["ctx", "store"])
    late = "/**\n * bind.go\n *\n * Part of the kit.\n *\n * Copyright 2020 the authors. All rights reserved.\n */"
    assert not informative(late, "bind", [])
    assert informative("/**\n * Binds the reader to the shard that holds its rows.\n * @param owner who holds all rights\n */", "bind", ["owner"])
