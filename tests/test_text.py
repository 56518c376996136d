import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import guards
from loomwork.functions.text import expand_token, fnv32a, fragments, glob_regex, newline_count, raw_tokens, token_estimate, truncate_runes, word_overlap
from loomwork.operators.lexical import query_terms


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def parts(word):
    """The identifier splitter, written out anew."""
    out, cur = [], ""
    for i, c in enumerate(word):
        if c == "_":
            out, cur = [*out, cur], ""
            continue
        p, n = word[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if cur and ((p.islower() and c.isupper()) or (p.isdecimal() != c.isdecimal()) or (p.isupper() and c.isupper() and n.islower())):
            out, cur = [*out, cur], ""
        cur += c
    return [x for x in [*out, cur] if x]


def test_fragments_against_plain_code(spark):
    words = ["handleSearchQuery", "target_symbol", "HTTPServer2", "a1B2", "ABc", "__x__", "x", "SHA256sum", "éTat", "v2", "_", "ABC", "fooBARBaz9_q"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["f"] for r in df.select("w", fragments(F.col("w")).alias("f")).collect()}
    assert got == {w: parts(w) for w in words}


def test_tokens(spark):
    tokens = one(spark, "func HTTPServer2() target_symbol, plain", lambda x: F.flatten(F.transform(raw_tokens(x), expand_token)))
    assert tokens == ["func", "httpserver2", "http", "server", "2", "target_symbol", "target", "symbol", "plain"]
    assert query_terms("func HTTPServer2") == ["func", "httpserver2", "http", "server", "2"]
    assert one(spark, None, lambda x: raw_tokens(x)) is None and one(spark, "", raw_tokens) == []


def test_estimates_and_cuts(spark):
    for n, want in ((0, 0), (1, 1), (2, 2), (3, 4), (9, 12)):
        assert one(spark, " w\n" * n, token_estimate) == want
    assert one(spark, None, token_estimate) == 0
    assert one(spark, "aéb漢c", lambda x: truncate_runes(x, 4)) == "aéb漢..." and one(spark, "abcd", lambda x: truncate_runes(x, 4)) == "abcd"
    for text, want in (("", 0), ("hello", 0), ("hello\nworld", 1), ("hello\nworld\n", 2), ("\n\n\n", 3)):
        assert one(spark, text, newline_count) == want
    assert one(spark, "b a b x", lambda x: word_overlap("a b c", x)) == 1.0 and one(spark, " ", lambda x: word_overlap("a", x)) is None


def test_fnv(spark):
    def plain(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    for text in ("", "a", "hello", "é漢", "x" * 300):
        assert one(spark, text, fnv32a) == plain(text)


@given(st.text(alphabet="ab/.*", max_size=8))
def test_literal_globs_match_themselves(name):
    plain = name.replace("*", "a")
    assert re.match(glob_regex(plain), plain)


def test_globs():
    assert re.match(glob_regex("*.go"), "a.go") and not re.match(glob_regex("*.go"), "b/a.go") and re.match(glob_regex("[a-c]?.ts"), "bx.ts")


def test_guards(spark):
    assert guards.check_regex("a+b") is None and guards.check_regex("(a+)+") == "nested quantifier" and guards.check_regex("a?" * 31) == "too many repetitions" and guards.check_regex("(a?b)*") == "nested quantifier"
    assert guards.check_regex("a" * 1001) and guards.check_regex("|".join("abcdefghijklmnopqrstuvwxyz")) and guards.check_regex("((((((a))))))") and guards.check_regex("(")
    assert guards.clamp(5, 10, 1) == 5 and guards.clamp(50, 1, 10) == 10 and guards.clean_query("a\x00b\tc", 4) == "ab\t"
    paths = ["a/b.go", "/etc/x", "../a", "a/../b", "", "~/x", "/".join("a" * 21)]
    got = {r["p"]: r["s"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", guards.is_safe_path(F.col("p")).alias("s")).collect()}
    assert got == {p: guards.safe_path(p) for p in paths} and sum(got.values()) == 1
    assert one(spark, "..a/b\\c\x00.txt", guards.safe_filename) == "a_b_c.txt" and one(spark, "..", guards.safe_filename) == "unnamed"
    assert one(spark, "a\x07b\n", guards.strip_control) == "ab\n"
