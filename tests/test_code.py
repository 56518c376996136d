import os

import pytest
from pyspark.sql import functions as F

from loomwork.operators import analysis, chunking, detect, hooks, incremental, kpi
from loomwork.operators.records import delete_prefix, latest, replace_by_path, set_status, upsert
from loomwork.sources.manifests import MANIFESTS, alias_table, joined_pieces, manifest_packages, strip_jsonc
from loomwork.sources.tree import allowed, ignore_patterns, path_tree, scan_files


def test_windows(spark):
    df = spark.createDataFrame([("a", "a" * 6000), ("b", ""), ("c", None), ("d", "x" * 13), ("e", "a" * 16000), ("f", "l\n" * 3000)], "id string, t string")
    got = {}
    for r in chunking.windows(df, "id", "t").orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(len(r["content"]))
    assert got["a"] == [3000, 3000, 1000] and got["d"] == [13] and set(got) == {"a", "d", "e", "f"}
    big = chunking.windows(df.where("id = 'e'"), "id", "t", 8000, 800).orderBy("chunk_no").collect()
    assert [(r["char_start"], r["char_start"] + len(r["content"])) for r in big] == [(0, 8000), (7200, 15200), (14400, 16000)]
    second = chunking.windows(df.where("id = 'f'"), "id", "t").where("chunk_no = 1").first()
    assert (second["start_line"], second["end_line"]) == (1251, 2751)


def test_imports_and_scores(spark):
    rows = [
        ("a.ts", 'import x from "module1";\nimport { X, Y as z } from \'module2\';\nconst q = require("module3");'),
        ("a.go", 'import "fmt"\nimport (\n\t"context"\n\tx "strings"\n\t"github.com/pkg/errors"\n)\n'),
        ("a.php", "<?php\nrequire_once 'vendor/autoload.php';\nuse App\\Models\\User;\nuse Some\\ClassA as A, Some\\ClassB;\n"), ("a.txt", "import x from 'y'"), ("a.go", None),
    ]
    df = spark.createDataFrame(rows, "p string, c string")
    got = [set(r[0]) for r in df.select(chunking.imports(F.col("p"), F.col("c"))).collect()]
    assert got == [{"module1", "module2", "module3", "X", "Y"}, {"fmt", "context", "strings", "github.com/pkg/errors"}, {"App\\Models\\User", "Some\\ClassA", "Some\\ClassB", "vendor/autoload.php"}, set(), set()]
    s = spark.createDataFrame([(1, 2, ["a"]), (1, 20, []), (1, 5, None)], "s int, e int, c array<string>")
    assert [r[0] for r in s.select(chunking.function_score(F.col("s"), F.col("e"), F.col("c"))).collect()] == [0.8, 1.2, 1.0]


def test_contextual_string(spark):
    df = spark.createDataFrame([("test.txt", None, None, "", None, [], {}, "body")], "p string, e string, r string, k string, d string, c array<string>, m map<string,string>, t string")
    full = spark.createDataFrame([("a.go", "Get", "Store", "method_declaration", "Reads.", ["b", "c"], {"y": "2", "x": "1"}, "body")], df.schema)
    assert full.select(chunking.contextual_string(*map(F.col, "perkdcmt"))).first()[0] == (
        "File: a.go. Entity: Get. Parent: Store. Type: method_declaration. Docstring: Reads.. Calls: b, c. [Structure: x=1 y=2 ] Code:\nbody"
    )
    assert df.select(chunking.contextual_string(*map(F.col, "perkdcmt"))).first()[0] == "File: test.txt. Entity: Global. Type: . Docstring: None. Calls: None. Code:\nbody"


CHUNK = "project_id string, rel_path string, type string, symbols array<string>, calls array<string>, relationships array<string>, content string, structural_metadata map<string,string>"


def chunks(spark):
    f = "function_declaration"
    rows = [
        ("p", "apps/api/main.ts", f, ["aliveFn"], ["run"], ["axios", "@org/shared"], "", {}), ("p", "apps/api/main.ts", f, ["deadFn"], [], [], "", {}),
        ("p", "a/b.ts", f, ["run", "_hidden"], ["aliveFn"], ["./local"], "", {}), ("p", "a/b_test.go", f, ["TestRun"], ["deadFn"], [], "uses deadFn and run", {}),
        ("q", "x.ts", f, ["deadFn", "main"], [], None, "", {}), ("p", "a/c.ts", f, ["Svc.go"], ["go"], None, None, None), (None, "n.ts", f, ["lost"], None, None, None, None),
        ("p", "s.ts", "struct_item", ["User"], [], [], "", {"field:ID": "int", "method:Get": "defined"}), ("p", "z.md", "Unknown", ["doc"], [], [], "", {}),
    ]
    return spark.createDataFrame(rows, CHUNK)


def test_set_differences(spark):
    c = chunks(spark)
    dead = {(r["project_id"], r["symbol"]) for r in analysis.dead_symbols(c).collect()}
    assert dead == {("p", "deadFn"), ("p", "_hidden"), ("q", "deadFn"), ("p", "User")}
    untested = {(r["project_id"], r["symbol"]) for r in analysis.missing_tests(c).collect()}
    assert untested == {("p", "aliveFn"), ("q", "deadFn"), ("p", "User"), ("p", "Svc.go")}
    imports = c.select("project_id", "rel_path", F.explode("relationships").alias("module"))
    manifest = spark.createDataFrame([("p", "lodash")], "project_id string, package string")
    lost = {r["package"]: r["n_files"] for r in analysis.missing_dependencies(imports, manifest).collect()}
    assert lost == {"axios": 1, "@org/shared": 1}
    edges = {(r["source"], r["target"]) for r in analysis.edges(imports, "@org/").collect()}
    assert edges == {("apps/api", "@org/shared")}
    assert [r["rel_path"] for r in analysis.field_usage(c, "ID").collect()] == ["s.ts"]


def test_division_aliases_rules(spark):
    req = spark.createDataFrame([("p", "I", "a"), ("p", "I", "b"), ("p", "J", "c"), ("p", "I", "a"), ("q", "K", "a"), ("p", "L", "none")], "project_id string, interface string, method string")
    off = spark.createDataFrame([("p", "S", "a"), ("p", "S", "b"), ("p", "S", "x"), ("p", "T", "a"), ("p", "T", "c")], "project_id string, type string, method string")
    assert {(r["interface"], r["type"]) for r in analysis.implementations(req, off).collect()} == {("I", "S"), ("J", "T")}
    a = spark.createDataFrame([("@/", "src/"), ("@/lib", "lib")], "alias string, target string")
    m = spark.createDataFrame([("@/x",), ("@/lib/y",), ("z",)], "module string")
    assert {r["module"]: r["resolved"] for r in analysis.resolve_aliases(m, a).collect()} == {"@/x": "src/x", "@/lib/y": "lib/y", "z": "z"}
    rules = [(1, "p", "There is no Lodash. Forbidden: axios"), (2, "p", "nothing here"), (3, "q", "no lodash"), (4, "p", "no no database/sql in internal/api, none"), (5, None, "no axios"), (6, "p", None)]
    rules = spark.createDataFrame(rules, "id int, project_id string, rule string")
    deps = spark.createDataFrame([("p", "lodash"), ("p", "axios"), ("p", "left"), ("p", "database/sql"), ("p", "no database"), ("p", ""), ("p", None), (None, "axios")], "project_id string, dep string")
    assert {(r["id"], r["dep"]) for r in analysis.forbidden(rules, deps).collect()} == {(1, "lodash"), (1, "axios"), (4, "database/sql"), (4, "no database")}


def test_mini_monorepo(spark):
    package = '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'
    scans = [(1, "p", "package.json", [("x:1", package[20:]), ("x:0", package[:20])]), (2, "p", "apps/api/go.mod", [("y:0", "module a\nrequire (\n\tgithub.com/x/y v1.2\n)\n")]), (3, "p", "requirements.txt", [("z:0", "# c\nflask==2\nnumpy\n")]), (4, "p", "a.ts", None)]
    scans = spark.createDataFrame(scans, "result_id int, project_id string, rel_path string, records array<struct<id:string,content:string>>")
    files = joined_pieces(scans, ["project_id", "rel_path"], "records", "text", F.element_at(F.split("rel_path", "/"), -1).isin(MANIFESTS))
    names = {r["package"] for r in manifest_packages(files, "rel_path", "text", ["project_id"]).collect()}
    assert {"react", "vite", "flask", "numpy"} <= names
    imports = spark.createDataFrame([("p", "apps/api/a.ts", m) for m in ("axios", "react", "@herexa/shared/x", "./own", "vite/client")], "project_id string, rel_path string, module string")
    lost = {r["package"] for r in analysis.missing_dependencies(imports, manifest_packages(files, "rel_path", "text", ["project_id"])).collect()}
    assert lost == {"axios", "@herexa/shared"}
    assert ("apps/api", "@herexa/shared/x") in {(r["source"], r["target"]) for r in analysis.edges(imports).collect()}


def test_test_files(spark):
    paths = {"a/b_test.go": True, "x/test/a.py": True, "x/tests/a.py": True, "test/a.py": False, "a_test.py": False, "a/contest/b.go": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", analysis.is_test(F.col("p")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in got} == paths


def test_lines_and_issues(spark):
    df = spark.createDataFrame([("d", "a\n  // TODO: fix it, FIXME later\nx"), ("e", None)], "id string, t string")
    hits = analysis.grep(df, "t", ["id"], F.col("line").rlike("TODO"), F.col("t").rlike("TODO")).collect()
    assert [(r["id"], r["line_no"], r["line"]) for r in hits] == [("d", 2, "// TODO: fix it, FIXME later")]
    issues = {r["keyword"]: r["message"] for r in analysis.pattern_issues(analysis.split_lines(df, "t", ["id"])).collect()}
    assert issues == {"TODO": "[TODO]: fix it, FIXME later", "FIXME": "[FIXME]: later"}


def test_incremental(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, hash string")
    store = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "p string, hash string")
    assert {r["p"]: r["state"] for r in incremental.compare(disk, store, ["p"]).collect()} == {"a": "indexed", "b": "modified", "c": "missing", "d": "deleted"}
    assert {r["p"] for r in incremental.to_index(disk, store, ["p"]).collect()} == {"b", "c"} and [r["p"] for r in incremental.stale(disk, store, ["p"]).collect()] == ["d"]


def test_store(spark):
    s = spark.createDataFrame([("a", "x/1", 1), ("b", "x/2", 1), ("b", "x/2", 2), ("c", "xy", 1)], "id string, path string, v int")
    assert {(r["id"], r["v"]) for r in latest(s, ["id"], ["v"]).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert upsert(latest(s, ["id"], ["v"]), spark.createDataFrame([("b", "x/2", 7)], s.schema), "id").where("v = 7").count() == 1
    assert [r["id"] for r in delete_prefix(s, F.col("path"), "x").collect()] == ["c"] and delete_prefix(s, F.col("path"), "").count() == 0
    assert {r["v"] for r in replace_by_path(s, spark.createDataFrame([("z", "x/2", 5)], s.schema), ["path"]).collect()} == {1, 5}
    st = spark.createDataFrame([("p", "old", 1), ("q", "ok", 1)], "project_id string, status string, at int")
    assert {r["status"] for r in set_status(st, spark.createDataFrame([("p", "new", 2)], st.schema)).collect()} == {"new", "ok"}


def test_tree(spark, tmp_path):
    files = ["main.go", "README.md", "utils.ts", "node_modules/x.js", "dist/a.js", "a.min.js", "package-lock.json", "img.png", "logs/x.txt", "keep.txt", "skip.txt", "doc.PDF", "noext"]
    for name in files:
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(name)
    (tmp_path / ".vector-ignore").write_text("# note\nlogs/\n*.txt\n!keep.txt\n")
    (tmp_path / ".gitignore").write_text("*.go\n")
    got = {r["rel_path"] for r in scan_files(spark, str(tmp_path)).collect()}
    assert got == {"main.go", "README.md", "utils.ts", "keep.txt"}
    with pytest.raises(FileNotFoundError):
        scan_files(spark, os.path.join(str(tmp_path), "absent"))
    assert ignore_patterns("a/b\n")[0][1].startswith("^a/b")
    df = spark.createDataFrame([("a/generated/x.go",), ("generated.go",), ("a.GO",), ("yarn.lock",)], "p string")
    assert [r["p"] for r in df.where(allowed(F.col("p"))).collect()] == ["generated.go"]
    tree = {(r["parent"], r["name"], r["is_dir"]) for r in path_tree(spark.createDataFrame([("a/b/c/d.go",), ("a/e.go",)], "p string"), "p", [], 2).collect()}
    assert tree == {("", "a", True), ("a", "b", True), ("a", "e.go", False)}


def test_manifests(spark):
    rows = [("p", "x/package.json", '{"dependencies": {"lodash": "1"}, "devDependencies": {"vite": "2"}}'), ("p", "go.mod", "module m\n\nrequire (\n\tgithub.com/a/b v1\n)\n"), ("p", "requirements.txt", "numpy==1\n# no\npandas\n"), ("p", "bad/package.json", "{"), ("p", "other", "x")]
    got = {r["package"] for r in manifest_packages(spark.createDataFrame(rows, "project string, path string, text string"), "path", "text", ["project"]).collect()}
    assert got == {"lodash", "vite", "module", "require", "github.com/a/b", "numpy", "pandas"}
    assert strip_jsonc('{"a": "//x", /* c */ "b": [1,2,], // d\n}') == '{"a": "//x",  "b": [1,2] \n}'
    assert alias_table('{"compilerOptions": {"paths": {"@/*": ["src/*"],}}}') == [("@/", "src/")]


def test_kpis(spark):
    hits = spark.createDataFrame([("q1", "a", 1), ("q1", "a", 2), ("q1", "b", 3), ("q2", "c", 1), ("q2", "d", 2)], "query string, item string, rank int")
    expected = spark.createDataFrame([("q1", "b"), ("q2", "z"), ("q3", "c")], "query string, item string")
    r = kpi.retrieval_kpis(hits, expected, 3).first()
    assert (r["n_queries"], r["recall"], r["mrr"], r["ndcg"]) == (3, round(1 / 3, 6), round(0.5 / 3, 6), round(1 / 1.584962500721156 / 3, 6))
    v = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert v.agg(kpi.nearest_rank("v", 0.95)).first()[0] == 10.0
    assert [r["n"] for r in kpi.histogram(v, "v", [1.0, 5.0]).orderBy("le").collect()] == [1, 5, 10]
    assert v.limit(0).agg(kpi.hit_rate(F.col("v") > 1)).first()[0] is None


def test_chunk_attributes(spark):
    go = "// Context: Store -> Open\n// Opens it\n// for reading.\nfunc (s *Store) Open() error {}\n\n// lost\n\nfunc main() {}\n"
    ts = "export class Panel extends Base {\n  // draws\n  async function draw() {}\n}\ntype T struct {\n\tID int\n\tNames []string\n}\ntype R interface {\n\tRead(p []byte) int\n}\n"
    df = spark.createDataFrame([("g", "a.go", go), ("t", "b.ts", ts), ("n", "c.py", None)], "id string, p string, t string")
    got = {r["id"]: r["x"] for r in df.select("id", detect.parent_symbol(F.col("p"), F.col("t")).alias("x")).collect()}
    assert got == {"g": "Store", "t": "Panel", "n": ""}
    docs = {(r["id"], r["name"]): r["docstring"] for r in detect.documented(df, "id", "t").collect()}
    assert docs == {("g", "Open"): "Opens it\nfor reading.", ("t", "draw"): "draws"}
    parts = {(r["key"], r["value"]) for r in detect.structure(df, "id", "t").collect()}
    assert parts == {("field:ID", "int"), ("field:Names", "[]string"), ("method:Read", "defined")}


def test_hooks(spark):
    df = spark.createDataFrame([(1, "code", "ab", 2.0), (2, "text", "abc", 1.0), (3, "text", None, 1.0)], "id int, kind string, t string, score double")
    length = lambda t: F.array(F.length(t).cast("double"), F.lit(1.0))
    zero = lambda t: F.array(F.lit(0.0), F.lit(0.0))
    got = {r["id"]: r["embedding"] for r in hooks.embed(df, "t", {"default": length, "code": zero}, 2, F.col("kind")).collect()}
    assert got == {1: [0.0, 0.0], 2: [3.0, 1.0], 3: None}
    with pytest.raises(Exception):
        hooks.embed(df, "t", {"default": length}, 3).collect()
    best = hooks.rerank(df, "id", "t", "score", lambda t: F.length(t).cast("double"), 2).collect()
    assert [(r["id"], r["reranked"]) for r in best] == [(1, 0.833333), (2, 0.75)]
