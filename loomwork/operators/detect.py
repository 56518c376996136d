"""What a text is: content type, language, definitions, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings by language, of documentation and of settings, and signs of code (fixed values).
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "c": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "cs": "csharp", "sh": "bash", "bash": "bash",
}
DOC_ENDINGS = ["md", "rst", "txt", "adoc"]
CONFIG_ENDINGS = ["json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env"]
CODE_SIGNS = [
    "func ", "function ", "def ", "class ", "public ", "private ", "import ", "package ", "require(", "const ", "let ", "var ", "if (", "for (",
    "while (", "return ", "=>",
]
#: Words before a bracket that call nothing (fixed values).
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "return", "func", "function", "def", "fn", "await", "typeof", "range", "match", "elif", "foreach", "empty", "array"]
#: The start of a top-level definition, by its first words.
DEFINITION = (
    r"(?m)^((?:(?:export|default|declare|pub|pub\(crate\)|async|abstract|final|static|public|private|protected)\s+)*"
    r"(?:func|function|def|class|fn|struct|enum|trait|impl|interface|type|const [A-Za-z_$][\w$]* = (?:async )?\()\b)"
)


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path, empty if unknown."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, ending(path)), F.lit(""))


def content_type(path: Column, content: Column) -> Column:
    """code, documentation, config or general: by the ending, else by two signs of code."""
    e = ending(F.coalesce(path, F.lit("")))
    low = F.lower(F.coalesce(content, F.lit("")))
    signs = F.lit(0)
    for s in CODE_SIGNS:
        signs = signs + F.contains(low, F.lit(s)).cast("int")
    return F.when(e.isin(list(LANGUAGES)) & (e != "cxx"), "code").when(e.isin(DOC_ENDINGS), "documentation").when(e.isin(CONFIG_ENDINGS), "config").when(signs >= 2, "code").otherwise("general")


def calls(content: Column) -> Column:
    """Distinct names before a bracket, sorted."""
    names = F.regexp_extract_all(content, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(CONTROL_WORDS))))


def definition_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text cut where top-level definitions begin; what comes before the first is a chunk too.

    id, chunk_no, kind (the first words, empty for the preamble), name,
    content, start_line, calls.  Nothing is lost: the chunks joined are the text.
    """
    mark = "\x01"
    marked = F.regexp_replace(text_col, DEFINITION, f"{mark}$1")
    parts = df.where(F.length(text_col) > 0).select(id_col, F.posexplode(F.split(marked, mark)).alias("chunk_no", "content"))
    from pyspark.sql import Window as W

    w = W.partitionBy(id_col).orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    rows = parts.withColumn("start_line", (F.coalesce(F.sum(lines).over(w), F.lit(0)) + 1).cast("int"))
    head = F.regexp_extract("content", DEFINITION, 1)
    name = F.regexp_extract("content", r"^(?:[\w()]+\s+)*?(?:func|function|def|class|fn|struct|enum|trait|impl|interface|type|const)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)", 1)
    return rows.where(F.length("content") > 0).select(
        id_col, "chunk_no", F.regexp_replace(head, r"^const .*", "const").alias("kind"), F.when(F.length(head) > 0, name).otherwise("").alias("name"), "content", "start_line", calls(F.col("content")).alias("calls")
    )


#: A definition with the line comments right above it: (comments, name).
DOCUMENTED = (
    r"(?m)^((?:[ \t]*(?://|#)[^\n]*\n)+)[ \t]*(?:(?:export|default|pub|async|static|public|private|protected)\s+)*"
    r"(?:func|function|def|fn|class|struct|type|interface)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)"
)
#: A Go method's receiver type, and a class with the name of its members' parent.
RECEIVER = r"(?m)^func\s*\(\s*(?:[A-Za-z_]\w*\s+)?\*?([A-Za-z_]\w*)"
CLASS = r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"
CONTEXT = r"^// Context: ([^\n]*?) -> "


def parent_symbol(path: Column, content: Column) -> Column:
    """What a chunk's definitions belong to: the parent named in its first line, a Go method's receiver, else the first class; empty if there is none."""
    named, receiver, klass = (F.regexp_extract(content, p, 1) for p in (CONTEXT, RECEIVER, CLASS))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.when(ending(path) == "go", receiver).otherwise(klass), F.lit("")), F.lit(""))


def documented(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Definitions with the line comments that end on the line above: id, name, docstring.

    Any line of code or blank line between resets the comment; marks and the
    blank behind them are taken off each line.  The first line of a chunk that
    names its parent is no comment.
    """
    body = F.regexp_replace(F.regexp_replace(text_col, r"\r\n", "\n"), CONTEXT + r"[^\n]*\n", "")
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(DOCUMENTED), F.lit(1)).alias("c"), F.regexp_extract_all(body, F.lit(DOCUMENTED), F.lit(2)).alias("n"))
    rows = df.select(id_col, F.explode(pairs).alias("p"))
    return rows.select(id_col, F.col("p.n").alias("name"), F.trim(F.regexp_replace("p.c", r"(?m)^[ \t]*(?://+|#+)[ \t]?", ""), F.lit("\n")).alias("docstring"))


#: The body of a Go struct or interface without inner brackets, and its lines.
STRUCT, INTERFACE = r"\bstruct\s*\{([^{}]*)\}", r"\binterface\s*\{([^{}]*)\}"
FIELD, METHOD = r"(?m)^[ \t]+([A-Za-z_]\w*)[ \t]+([*\[\]A-Za-z_][\w.*\[\]]*)", r"(?m)^[ \t]+([A-Za-z_]\w*)\("


def structure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fields with their types and methods of structs and interfaces: id, key (``field:`` or ``method:`` and the name), value."""
    bodies = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(STRUCT), F.lit(1))).alias("b"))
    fields = bodies.select(id_col, F.explode(F.arrays_zip(F.regexp_extract_all("b", F.lit(FIELD), F.lit(1)).alias("n"), F.regexp_extract_all("b", F.lit(FIELD), F.lit(2)).alias("t"))).alias("f"))
    faces = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(INTERFACE), F.lit(1))).alias("b"))
    methods = faces.select(id_col, F.explode(F.regexp_extract_all("b", F.lit(METHOD), F.lit(1))).alias("n"))
    return (
        fields.select(id_col, F.concat(F.lit("field:"), "f.n").alias("key"), F.col("f.t").alias("value"))
        .unionByName(methods.select(id_col, F.concat(F.lit("method:"), "n").alias("key"), F.lit("defined").alias("value"))).distinct()
    )
