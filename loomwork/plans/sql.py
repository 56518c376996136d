"""SQL fragments shared by the oracle queries (DuckDB)."""

from __future__ import annotations

_BREAKS = "raw"
for _a, _b in (
    (r"(\p{Ll})(\p{Lu})", r"\1 \2"),
    (r"(\p{Nd})([^\p{Nd}_ ])", r"\1 \2"),
    (r"([^\p{Nd}_ ])(\p{Nd})", r"\1 \2"),
    (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"),
):
    _BREAKS = f"regexp_replace({_BREAKS}, '{_a}', '{_b}', 'g')"
#: Fragments of ``raw``, in order.
FRAGMENTS = f"list_filter(regexp_split_to_array({_BREAKS}, '[_ ]+'), lambda x: x <> '')"
TOKENS = f"list_concat([lower(raw)], list_filter(list_transform({FRAGMENTS}, lambda x: lower(x)), lambda x: x <> lower(raw)))"
WORDS = r"list_filter(regexp_split_to_array({0}, '[\s\x0B\x85\p{{Z}}]+'), lambda x: x <> '')"


def tokens(source: str, id_col: str, text: str) -> str:
    """Common tables ``raws`` and ``toks`` (id, term)."""
    return (
        f"raws AS (SELECT {id_col} AS id, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{Nd}}_]+')) AS raw FROM {source}), "
        f"toks AS (SELECT id, unnest({TOKENS}) AS term FROM raws)"
    )


def bm25(source: str, id_col: str, text: str, terms: list[str], name: str = "scored") -> str:
    """Common tables up to ``scored`` (id, score)."""
    q = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    return (
        tokens(source, id_col, text)
        + f", per AS (SELECT id, count(*) AS dl FROM toks GROUP BY id), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM per), q(term, w) AS (VALUES {q}), "
        "tf AS (SELECT id, term, count(*) AS tf FROM toks JOIN q USING (term) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
        f"{name} AS (SELECT id, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score "
        "FROM tf JOIN df USING (term) JOIN q USING (term) JOIN per USING (id), stats GROUP BY id)"
    )


#: The last version of each record.
RECORDS = "rec AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, rec_no DESC NULLS LAST) = 1)"
#: A usable vector of 64 entries, and its norm.
USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
VECTORS = f"vec AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM rec WHERE {USABLE})"
COSINE = "list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)))"


def _listed(key: str) -> str:
    return f"CASE WHEN starts_with(trim(coalesce(metadata['{key}'], '')), '[') AND json_valid(metadata['{key}']) AND json_array_length(metadata['{key}']) > 0 THEN from_json(metadata['{key}'], '[\"VARCHAR\"]') ELSE [metadata['{key}']] END"


#: What is indexed of a record.
STORE_TEXT = (
    f"array_to_string(list_filter(list_transform(list_concat([content, metadata['name'], metadata['path']], {_listed('symbols')}, {_listed('calls')}), "
    "lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), ' ')"
)
