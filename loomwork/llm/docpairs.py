"""Problem 2: functions paired with their documentation."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of source files that hold functions, and the family of their syntax (fixed values).
LANGUAGES = {".go": "go", ".ts": "js", ".tsx": "js", ".js": "js", ".py": "py", ".php": "php", ".rs": "rs"}

_ID = r"[A-Za-z_$][\w$]*"
_DEFINITIONS = {
    "go": [re.compile(rf"^\s*func\s*(?:\([^)]*\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?\s*\((?P<args>[^)]*)")],
    "py": [re.compile(rf"^\s*(?:async\s+)?def\s+(?P<name>{_ID})\s*(?:\[[^\]]*\])?\s*\((?P<args>[^)]*)")],
    "php": [re.compile(rf"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?\s*(?P<name>{_ID})\s*\((?P<args>[^)]*)")],
    "rs": [
        re.compile(
            rf"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<name>{_ID})\s*(?:<[^(]*>)?\s*\((?P<args>[^)]*)"
        )
    ],
    "js": [
        re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*(?:<[^(]*>)?\s*\((?P<args>[^)]*)"),
        re.compile(
            rf"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\s*)?"
            rf"(?:function\b[^(]*\((?P<args>[^)]*)|(?:<[^(]*>\s*)?\((?P<args2>[^)]*)(?:\)[^=;]*=>|$)|(?P<args3>{_ID})\s*=>)"
        ),
        re.compile(
            rf"^\s*(?:(?:public|protected|private|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<name>#?{_ID})\s*(?:<[^(]*>)?\s*\((?P<args>[^)]*)(?:\)\s*(?::[^{{=;]*)?\{{.*|,?)$"
        ),
        re.compile(rf"^\s*(?:(?:public|protected|private|static|readonly)\s+)*(?P<name>{_ID})\s*=\s*(?:async\s*)?\((?P<args>[^)]*)\)[^=;]*=>"),
    ],
}
#: Words before a bracket that define nothing (fixed values).
_CONTROL = set("if for while switch catch function return await typeof new super else do try with import throw delete void yield in of case".split())
_DECORATOR = re.compile(r"^\s*(@[\w.]+.*|#!?\[.*\])\s*$")
_CONTEXT = re.compile(r"^\s*// Context: .* -> ")
_LINE_COMMENT = {"py": re.compile(r"^\s*#(?!!)"), "php": re.compile(r"^\s*(//|#(?!\[))")}
_SLASHES = re.compile(r"^\s*//")
_MARKS = re.compile(r"^[\s/*#!\"'`~=+\-_.<>|]*(?:[rRuUbB](?=\"\"\"|'''))?|[\s/*#\"'`~=+\-_<>|]*$")
_TOOL = re.compile(
    r"^(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8 |v8 |noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|pragma|nolint|go:[a-z]+|\+build"
    r"|phpcs|phpstan|psalm|codingstandards|@?ts-(?:ignore|expect|nocheck)|@phpstan|@psalm|fmt:|isort|yapf|black|rustfmt|clippy|lint|cspell|spell|nosec"
    r"|nosonar|biome|deno-|webpack|@?vite|@jsx|@flow|@format|#?\[\w+|#?!\[|region\b|endregion\b|\$id\b|vim:|coding[:=]|-\*-)",
    re.I,
)
_LICENCE = re.compile(
    r"^\W*(?:copyright|\(c\)|©|licen[cs]ed?\b|spdx|all rights reserved|use is governed|distributed under|permission is hereby|released under|this file is part of)"
    r"|spdx-license|all rights reserved",
    re.I,
)
#: Lines that speak of a function's parameters or results.
_ABOUT = re.compile(r"^(?:[@\\:](?:param|arg|return|throws|raises|yields)|(?:args|arguments|parameters|returns|raises|yields):)", re.I)
_TAG = re.compile(r"^[@\\:](?P<tag>[a-zA-Z]+)\s*(?P<rest>.*)$")
_INLINE_TAG = re.compile(r"\{@\w+[^}]*\}")
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip|n/?a|none|null|nil|undefined|pending|stub|docstring|description|summary|comment)\b\W*", re.I)
_FILLER = set("document docs doc documentation documented write add adds description describe describes this me later fix fill in needed needs need missing here please method function comment comments it to be done something explain undocumented".split())
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[\w.$\[\]\"'>-]+\s*(?::=|=|\+=|-=|<-)\s*\S|^\s*(?:if|for|while|switch|elif|return|const|let|var|fn|def|func|function|import|from|use|await|defer|go|try|with)\b.*[(){}=;:\[\].]\s*\S*$"
    r"|^\s*[\w.$:>-]+[!?]?\(.*\)\s*[;,{?]*$|^\s*(?:</?\w+[^>]*>)+$"
)
_STOP = set(
    "the a an of to for and or in on at by with from this that these those is are be it its as into when if function method func fn def helper returns return "
    "does do implementation implements param params parameter parameters arg args argument arguments value values given see also void self".split()
)
_WORD = re.compile(r"[^\W\d_]+|\d+", re.U)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+")


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ings", "ing", "ies", "ers", "ed", "es", "er", "e", "s", "y"):
        if len(w) - len(end) >= 3 and w.endswith(end):
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_words(*names: str) -> set[str]:
    return {_stem(p) for n in names for p in _CAMEL.split(n) for p in _WORD.findall(p)}


def clean_lines(doc: str) -> list[str]:
    """The lines of a comment or docstring without its marks."""
    return [x for x in (_MARKS.sub("", line) for line in doc.replace("\r", "").split("\n")) if x]


def _is_licence(lines: list[str]) -> bool:
    """A notice of rights: its first line is one, or one stands among its lines and no line tells of parameters or results."""
    if _LICENCE.search(lines[0]):
        return True
    return any(_LICENCE.search(x) for x in lines) and not any(_ABOUT.match(x) for x in lines)


def informative(doc: str | None, name: str, params: list[str]) -> bool:
    """Whether a text tells more than the function's own name and parameters."""
    if not doc:
        return False
    lines = clean_lines(doc)
    lines = [x for x in (_INLINE_TAG.sub("", x).strip() for x in lines) if x and not _TOOL.match(x)]
    if not lines or _is_licence(lines):
        return False
    if all(_CODE.search(x) for x in lines):
        return False
    own = name_words(name, *params)
    known = own | {_stem(name)}
    left: list[str] = []
    for line in lines:
        tag = _TAG.match(line)
        if tag:
            rest = re.sub(r"\{[^}]*\}", " ", tag["rest"])
            if tag["tag"].lower() in ("param", "arg", "argument", "property", "template"):
                rest = re.sub(r"^\s*(?:[\w\\|<>\[\]?]+\s+)?[$\[]?[\w.]+\]?", " ", rest, count=1) if "$" in rest else re.sub(r"^\s*\[?[\w.$]+\]?", " ", rest, count=1)
            elif tag["tag"].lower() in ("return", "returns", "type", "throws", "see", "since", "author", "version") and len(rest.split()) < 3:
                rest = ""
            line = rest
        if _PLACEHOLDER.match(line):
            rest = _PLACEHOLDER.sub("", line)
            if all(w.lower() in _FILLER for w in _WORD.findall(rest)):
                continue
            line = rest
        for raw in re.findall(r"[\w$]+", line):
            if raw == name or raw in params:
                continue
            left += [w for p in _CAMEL.split(raw) for w in _WORD.findall(p)]
    words = [w for w in left if w.lower() not in _STOP and _stem(w) not in known]
    if any(ord(c) > 0x2E80 for w in words for c in w):
        return sum(len(w) for w in words) >= 4
    return len(words) >= 2


#: Strings, comments and single characters of JavaScript.
_PIECE = re.compile(r"//|/\*.*?(?:\*/|$)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|.")


def _may_define(line: str, lang: str) -> bool:
    """A cheap test before the patterns."""
    if lang != "js":
        return {"go": "func", "py": "def ", "php": "function", "rs": "fn "}[lang] in line
    return "=>" in line or "function" in line or ("(" in line and not line.endswith(";"))


def _body_follows(lines: list[str], at: int, start: int) -> bool:
    """Whether a body opens behind the brackets that open before ``start`` of a line, however many lines they take."""
    depth, behind, block = 1, "", False
    for n, line in enumerate(lines[at:]):
        if block:
            if "*/" not in line:
                continue
            line, block = line.split("*/", 1)[1], False
        for m in _PIECE.finditer(line, start if n == 0 else 0):
            piece = m[0]
            if piece.startswith("//"):
                break
            if piece.startswith("/*"):
                block = not piece.endswith("*/")
            elif depth:
                depth += (piece in "([{") - (piece in ")]}")
            elif piece == "{":
                return re.fullmatch(r"\s*(?::.*)?", behind, re.S) is not None
            elif piece == ";":
                return False
            else:
                behind += piece
        behind += " "
        if not depth and behind.strip() and not behind.lstrip().startswith(":"):
            return False
    return False


#: Comments, strings and single characters; Rust's quotes also begin lifetimes.
_ARGUMENT = {"rs": re.compile(r"//|/\*.*?(?:\*/|$)|\"(?:[^\"\\]|\\.)*\"|."), "py": re.compile(r"#|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|."), "php": re.compile(r"//|#(?!\[)|/\*.*?(?:\*/|$)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|.")}


def _arguments(lines: list[str], at: int, start: int, lang: str) -> str | None:
    """What stands between the brackets that open before ``start`` of a line, however many lines they
    take, without comments and what is in inner brackets; None if they never close."""
    depth, out, pattern = 1, [], _ARGUMENT.get(lang, _PIECE)
    angles = lang in ("js", "rs")
    for n, line in enumerate(lines[at:]):
        for m in pattern.finditer(line, start if n == 0 else 0):
            piece = m[0]
            if piece in ("//", "#"):
                break
            if piece.startswith("/*"):
                continue
            around = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
            if piece in "([{" or angles and piece == "<" and around[1] not in ("=", "<", " ") and around[0] not in ("<", " "):
                depth += 1
            elif piece in ")]}" or angles and piece == ">" and depth > 1 and around[0] not in ("=", "-", " "):
                depth -= 1
                if not depth:
                    return "".join(out)
            elif depth == 1:
                out.append(piece)
        out.append(" ")
    return None


def find_functions(content: str, lang: str) -> list[dict]:
    """Functions and methods of a piece of code: name, params, line, and the texts beside them."""
    lines = content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    single = _LINE_COMMENT.get(lang, _SLASHES)
    found = []
    quote = comment = None
    for i, line in enumerate(lines):
        if lang == "py":  # inside a triple-quoted text nothing is defined
            if quote:
                if quote in line:
                    quote = None
                continue
            for q in ('"""', "'''"):
                if line.count(q) % 2 == 1 and not line.lstrip().startswith("#"):
                    quote = q
                    break
        elif comment or line.lstrip().startswith("/*"):
            comment = "*/" not in line.split("/*")[-1]
            if comment or line.rstrip().endswith("*/"):
                continue
        if not _may_define(line, lang) or single.match(line):
            continue
        for k, pattern in enumerate(_DEFINITIONS[lang]):
            m = pattern.match(line)
            if not m:
                continue
            if lang == "js" and k == 2:
                if m["name"] in _CONTROL:
                    continue
                # a method, not a call: a body must open behind the brackets
                if not line.rstrip().endswith("{") and not _body_follows(lines, i, m.start("args")):
                    continue
            g = next((g for g in ("args", "args2", "args3") if g in m.groupdict() and m[g] is not None), None)
            args = "" if g is None else m[g]
            if g in ("args", "args2"):
                args = _arguments(lines, i, m.start(g), lang) or args
            params = re.findall(rf"(?:^|,)\s*(?:mut\s+|\.\.\.|\*+|&\s*|[\\\w?|]+\s+(?=\$))*\$?({_ID})", args)
            found.append({"name": m["name"].lstrip("#"), "params": [p for p in params if p not in ("self", "cls", "this")], "line": i, "above": _above(lines, i, single), "inside": _inside(lines, i) if lang == "py" else None})
            break
    return found


def _above(lines: list[str], at: int, single: re.Pattern) -> tuple[int, str] | None:
    """The comment that ends on the line directly above, decorators aside: (distance in lines, text)."""
    i = at - 1
    while i >= 0 and _DECORATOR.match(lines[i]):
        i -= 1
    if i < 0:
        return None
    if single.match(lines[i]):
        j = i
        while j >= 0 and single.match(lines[j]) and not (_CONTEXT.match(lines[j]) and j == 0):
            j -= 1
        return (at - i, "\n".join(lines[j + 1 : i + 1])) if j < i else None
    if lines[i].rstrip().endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        if j >= 0 and lines[j].lstrip().startswith("/*"):
            return at - i, "\n".join(lines[j : i + 1])
    return None


def _inside(lines: list[str], at: int) -> str | None:
    """The string that opens a Python body."""
    i, depth = at, 0
    while i < len(lines):
        code = re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", lines[i])
        depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
        if depth <= 0 and code.rstrip().endswith(":"):
            break
        if depth <= 0 and ":" in code and not code.rstrip().endswith(":"):
            return None
        i += 1
    i += 1
    while i < len(lines) and not lines[i].strip():
        i += 1
    if i >= len(lines):
        return None
    m = re.match(r"^\s*[rRuU]?(\"\"\"|'''|\"|')", lines[i])
    if not m:
        return None
    q, first = m[1], lines[i][m.end() :]
    if q in first:
        return first[: first.index(q)]
    if len(q) == 1:
        return None
    text = [first]
    for line in lines[i + 1 :]:
        if q in line:
            return "\n".join([*text, line[: line.index(q)]])
        text.append(line)
    return "\n".join(text)


def assign(n_docs: int, links: list[tuple[int, int, float]]) -> dict[int, int]:
    """Best bipartite assignment of documents to functions: the greatest total weight.

    Successive cheapest augmenting paths over the given links only, which are
    few: a comment links to the function below it, a docstring to the functions
    of its chunk.  Result: document -> function.
    """
    out: dict[int, list[tuple[int, float]]] = {}
    for d, f, w in links:
        if w > 0:
            out.setdefault(d, []).append((f, w))
    match_f: dict[int, tuple[int, float]] = {}
    for d in range(n_docs):
        # Bellman-Ford over alternating paths that start at d; gain = added weight
        best: dict[int, tuple[float, int, int | None]] = {}
        heap = [(-w, f, d, None) for f, w in out.get(d, [])]
        heapq.heapify(heap)
        goal = None
        while heap:
            cost, f, doc, before = heapq.heappop(heap)
            if f in best and best[f][0] <= cost:
                continue
            best[f] = (cost, doc, before)
            if f not in match_f:
                if goal is None or cost < best[goal][0]:
                    goal = f
                continue
            held, w = match_f[f]
            for g, w2 in out.get(held, []):
                if g != f:
                    heapq.heappush(heap, (cost + w - w2, g, held, f))
        # giving up the document that gains least is better than a loss
        drop = min(((c + match_f[f][1], f) for f, (c, _, _) in best.items() if f in match_f), default=(0.0, None))
        end = goal if goal is not None and best[goal][0] < min(0.0, drop[0]) else drop[1] if drop[0] < 0 else None
        while end is not None:
            _, doc, before = best[end]
            match_f[end] = (doc, next(w for g, w in out[doc] if g == end))
            end = before
    return {d: f for f, (d, _) in match_f.items()}


def pair_chunk(content: str, docstring: str | None, symbols: list[str] | None, lang: str) -> list[tuple[str, int, str, str]]:
    """(symbol, line, origin, documentation) of the documented functions of one chunk."""
    functions = find_functions(content, lang)
    if not functions:
        return []
    docs: list[tuple[str, str]] = []
    links: list[tuple[int, int, float]] = []
    named = {s.rsplit(".", 1)[-1] for s in symbols or [] if s}
    for f, fn in enumerate(functions):
        for origin, text, distance in (("inside", fn["inside"], 0), ("above", *(reversed(fn["above"]) if fn["above"] else (None, 0)))):
            if text and informative(text, fn["name"], fn["params"]):
                links.append((len(docs), f, 4.0 + _mentions(text, fn) - 0.25 * distance + (origin == "inside")))
                docs.append((origin, text))
    if docstring and docstring.strip():
        for f, fn in enumerate(functions):
            score = _mentions(docstring, fn) + (1.5 if fn["name"] in named else 0.0) + (1.0 if f == 0 else 0.0)
            if score > 0 and informative(docstring, fn["name"], fn["params"]):
                links.append((len(docs), f, score - 0.001 * f))
        docs.append(("docstring", docstring))
    matched = assign(len(docs), links)
    # one row a function; its own comment goes before the chunk's docstring
    return [(functions[f]["name"], functions[f]["line"], docs[d][0], docs[d][1]) for d, f in sorted(matched.items(), key=lambda x: x[1])]


def _mentions(text: str, fn: dict) -> float:
    """Links by name and by parameter tags."""
    words = set(re.findall(r"[\w$]+", text))
    tags = set(re.findall(r"@param\s+(?:\{[^}]*\}\s*)?(?:[\w\\|]+\s+)?\$?([\w]+)", text)) & set(fn["params"])
    return 3.0 * (fn["name"] in words) + min(2.0, 1.0 * len(tags))


def function_docs(
    df: DataFrame,
    id_col: str = "chunk_id",
    path_col: str = "rel_path",
    text_col: str = "content",
    doc_col: str = "docstring",
    symbols_col: str = "symbols",
) -> DataFrame:
    """Code-description pairs: id, symbol, line (in the chunk, from 0), origin, documentation.

    Candidates are the string inside a Python body, the comment ending directly
    above (decorators aside), and the chunk's docstring; they are matched to the
    chunk's functions by the greatest total weight of parameter tags, names and
    distance.  Marks, placeholders, tool instructions, licence notices, disabled
    code, bare tags and texts that only repeat the name are no documentation.

    Defined cases: rows whose path is null or has no ending of ``LANGUAGES``,
    and null or empty contents, give no rows; a null docstring or symbols, or
    null entries in them, count as none; repeated ids and repeated names in a
    chunk give each (id, symbol, line) once; very long chunks are read whole;
    other columns are ignored; an empty table gives an empty result.
    """
    ending = F.regexp_extract(F.col(path_col), r"(\.[A-Za-z]+)$", 1)
    rows = df.where(ending.isin(list(LANGUAGES)) & (F.length(text_col) > 0)).select(
        F.col(id_col).alias("_id"), ending.alias("_e"), F.col(text_col).alias("_t"), F.col(doc_col).alias("_d"), F.col(symbols_col).alias("_s")
    )
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("_e", "_t", "_d", "_s")]
            for r, (e, t, d, s) in enumerate(zip(*columns)):
                for found in pair_chunk(t, d, s, LANGUAGES[e]):
                    ids.append(r)
                    out.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(ids, pa.int32())),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.int32()),
                    pa.array([x[2] for x in out], pa.string()),
                    pa.array([x[3] for x in out], pa.string()),
                ],
                names=[id_col, "symbol", "line", "origin", "documentation"],
            )

    pairs = rows.mapInArrow(run, f"`{id_col}` {kind}, symbol string, line int, origin string, documentation string")
    return pairs.groupBy(id_col, "symbol", "line").agg(F.min("origin").alias("origin"), F.min_by("documentation", "origin").alias("documentation"))
