"""The comparison SQL (DuckDB) for every query, written apart from the library.

RE2 has no lookahead and no possessive groups, so the patterns differ from the library's.
"""

from __future__ import annotations

from checks.inputs import CHUNKS_SQL, GENERATED_SQL, SCRIPTS_SQL, STATEMENTS_SQL
from scriptloom.operators import convert

_BLANK_CODES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BLANKS = "".join(map(chr, _BLANK_CODES))
_BREAKS = "".join(map(chr, (10, 11, 12, 13, 28, 29, 30, 0x85, 0x2028, 0x2029)))
_B = f"[{_BLANKS}]"


def _strip(x: str) -> str:
    return f"trim({x}, '{_BLANKS}')"


def _nonblank(pieces: str) -> str:
    return f"list_filter({pieces}, lambda q: {_strip('q')} <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(source: str, pieces: str, keys: str, number: str, value: str) -> str:
    """The elements of a list per row of ``source``, numbered from 1."""
    return (
        f"SELECT {keys}, cast(unnest(generate_series(1, len(ps))) AS integer) AS {number},"
        f" unnest(ps) AS {value} FROM (SELECT {keys}, {pieces} AS ps FROM ({source}))"
    )


def _words(x: str) -> str:
    return f"cast(len(regexp_extract_all({x}, '[^{_BLANKS}]+')) AS integer)"


_BLOCK = (
    f"(?is)CREATE{_B}+(?:OR{_B}+REPLACE{_B}+)?(?:FUNCTION|PROCEDURE|PACKAGE|TRIGGER).*?END{_B}*;"
    f"|DECLARE.*?END{_B}*;|BEGIN.*?END{_B}*;|[^;]+;"
)
_NORMAL = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_FOUND = _nonblank(
    f"list_transform(regexp_extract_all({_NORMAL}, '{_BLOCK}'), lambda b: {_strip('b')})"
)
_EXTRACTED = _rows(SCRIPTS_SQL, _FOUND, "script_id", "block_no", "block")


def _has_code(x: str) -> str:
    stripped = _strip("l")
    return (
        f"len(list_filter(string_split({x}, chr(10)),"
        f" lambda l: {stripped} <> '' AND NOT starts_with({stripped}, '--'))) > 0"
    )


def _begin_pieces(x: str) -> str:
    marked = f"regexp_replace({x}, '(?i)(BEGIN)', chr(1) || '\\1', 'g')"
    return _nonblank(f"list_transform(string_split({marked}, chr(1)), lambda p: {_strip('p')})")


_STATE = "{{'done': {done}, 'run': {run}, 'size': {size}, 's': {s}}}"
_EMPTY = "[]::varchar[]"


def _fold(elements: str, closing: str, open_before: str = "false") -> str:
    """Runs of list elements joined by a newline.

    ``closing`` tells whether the run ends with element x.s, ``open_before`` whether it ends
    before it; both see the state a.
    """
    items = (
        f"list_transform({elements}, lambda e: "
        + _STATE.format(done=_EMPTY, run=_EMPTY, size="0", s="e")
        + ")"
    )
    joined = "array_to_string({}, chr(10))"
    extended = "list_append(a.run, x.s)"
    after_cut = f"list_append(list_append(a.done, {joined.format('a.run')}), x.s)"
    step = (
        f"CASE WHEN {open_before} AND len(a.run) > 0 THEN "
        + _STATE.format(done=after_cut, run=_EMPTY, size="0", s="''")
        + f" WHEN {closing} OR {open_before} THEN "
        + _STATE.format(done=f"list_append(a.done, {joined.format(extended)})", run=_EMPTY, size="0", s="''")
        + " ELSE "
        + _STATE.format(done="a.done", run=extended, size="a.size + length(x.s)", s="''")
        + " END"
    )
    start = _STATE.format(done=_EMPTY, run=_EMPTY, size="0", s="''")
    folded = f"list_reduce({items}, lambda a, x: {step}, {start})"
    rest = f"CASE WHEN len(f.run) > 0 THEN list_append(f.done, {joined.format('f.run')}) ELSE f.done END"
    return f"list_transform([{folded}], lambda f: {rest})[1]"


def _packed(x: str, max_chars: int, stripped: bool = True) -> str:
    statements = f"list_transform({_nonblank(f'''string_split({x}, ';')''')}, lambda t: t || ';')"
    runs = _fold(statements, f"a.size + length(x.s) > {max_chars}")
    return f"list_transform({runs}, lambda r: {_strip('r')})" if stripped else runs


def _merged(blocks: str) -> str:
    return _fold(
        _nonblank(blocks),
        "length(x.s) < 180 AND a.size + length(x.s) > 300",
        open_before="length(x.s) >= 180",
    )


def _resplit(blocks: str, max_chars: int) -> str:
    packed = _packed("b", max_chars, stripped=False)
    return f"flatten(list_transform({blocks}, lambda b: CASE WHEN length(b) > {max_chars} THEN {packed} ELSE [b] END))"


# The chunker over rows: extracted blocks, their pieces, then one list per script again.
_PIECES = _begin_pieces("block")
_CUT = (
    f"CASE WHEN length(block) > 1200 THEN list_filter(flatten(list_transform({_PIECES},"
    f" lambda p: CASE WHEN length(p) > 1200 THEN {_packed('p', 1200)} ELSE [p] END)),"
    f" lambda h: {_has_code('h')})"
    f" WHEN regexp_matches(block, '^(?i:CREATE|DECLARE|BEGIN)') AND NOT ({_has_code('block')})"
    f" THEN {_EMPTY} ELSE [block] END"
)
_FINE = (
    f"SELECT script_id, flatten(list(ps ORDER BY block_no)) AS fine FROM"
    f" (SELECT script_id, block_no, {_CUT} AS ps FROM ({_EXTRACTED})) GROUP BY script_id"
)
_CHUNK_LISTS = (
    f"SELECT script_id, list_filter({_resplit('merged', 1200)}, lambda h: {_has_code('h')}) AS chunked"
    f" FROM (SELECT script_id, {_merged('fine')} AS merged FROM ({_FINE}))"
)
_CHUNKED = _rows(_CHUNK_LISTS, "chunked", "script_id", "block_no", "block")


# Tokens
_TOKEN = (
    r"--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'"
    rf'|"[^"]*"|[0-9]+(?:\.[0-9]+)?|[\p{{L}}_][\p{{L}}0-9_$#]*'
    rf"|:=|<=|>=|<>|!=|\|\||=>|\.\.|[-+*/<>=%]|[^{_BLANKS}]"
)


# Compound statements: a walk over the tokens of a text that are no comments.
_LEXICAL = (
    r"(?:[^;'" + r'"' + r"/-]|'(?:[^']|'')*'" + r'|"[^"]*"|--[^\n]*|/\*[\s\S]*?\*/|' + r"[-/'" + r'"])*;?'
)
_WALK = "{{'ends': {ends}, 'seen': {seen}, 'depth': {depth}, 'awaits': {awaits}, 'creates': {creates}, 't': {t}}}"
_MARKS = "'BEGIN', 'END', 'CASE', 'DECLARE', 'CREATE', 'PACKAGE', 'IF', 'LOOP', 'FUNCTION', 'PROCEDURE', 'TRIGGER'"


def _walked(token: str) -> str:
    def to(**changed: str) -> str:
        kept = {"ends": "a.ends", "seen": "a.seen", "depth": "a.depth", "awaits": "a.awaits", "creates": "a.creates"}
        return _WALK.format(**{**kept, "t": "''", **changed})

    top = "a.depth = 0 AND NOT a.awaits"
    ended = to(ends="list_append(a.ends, a.seen + 1)", seen="a.seen + 1", creates="false")
    return f"""CASE
      WHEN {token} = ';' THEN CASE WHEN {top} THEN {ended} ELSE {to(seen="a.seen + 1")} END
      WHEN {token} = 'BEGIN' THEN {to(depth="a.depth + 1", awaits="false")}
      WHEN {token} = 'CASE' THEN {to(depth="a.depth + 1")}
      WHEN {token} IN ('IF', 'LOOP') THEN CASE WHEN a.depth > 0 THEN {to(depth="a.depth + 1")} ELSE {to()} END
      WHEN {token} = 'END' THEN {to(depth="greatest(a.depth - 1, 0)")}
      WHEN {token} = 'DECLARE' THEN CASE WHEN {top} THEN {to(awaits="true")} ELSE {to()} END
      WHEN {token} = 'CREATE' THEN {to(creates=f"({top})")}
      WHEN {token} = 'PACKAGE' THEN CASE WHEN a.creates AND a.depth = 0 THEN {to(depth="a.depth + 1", creates="false")}
        ELSE {to(creates="false")} END
      WHEN a.creates AND a.depth = 0 THEN {to(awaits="true", creates="false")}
      ELSE {to(creates="false")} END"""


def _compound(source: str, keys: str, text: str) -> str:
    """Keys and the list ss of the statements of a text per row of ``source``."""
    start = _WALK.format(ends="[]::bigint[]", seen="0", depth="0", awaits="false", creates="false", t="''")
    item = _WALK.format(ends="[]::bigint[]", seen="0", depth="0", awaits="false", creates="false", t="m")
    piece = _strip("array_to_string(segs[(coalesce(ends[i - 1], 0) + 1):e], '')")
    return f"""
        SELECT {keys}, list_filter(list_transform(ends, lambda e, i: {piece}), lambda p: p NOT IN ('', ';')) AS ss
        FROM (SELECT {keys}, segs, list_sort(list_distinct(list_append(f.ends, len(segs)))) AS ends
        FROM (SELECT {keys}, segs, list_reduce(list_transform(ms, lambda m: {item}), lambda a, x: {_walked("x.t")}, {start}) AS f
        FROM (SELECT {keys}, segs, list_filter(list_transform(ts, lambda t, i: CASE
            WHEN t IN ('CASE', 'IF', 'LOOP') AND i > 1 AND ts[i - 1] = 'END' THEN '' ELSE t END),
          lambda t: t IN (';', {_MARKS})) AS ms
        FROM (SELECT {keys}, list_filter(regexp_extract_all({text}, {_quoted(_LEXICAL)}), lambda g: g <> '') AS segs,
          list_transform(list_filter(regexp_extract_all({text}, {_quoted(_TOKEN)}),
            lambda t: NOT (starts_with(t, '--') OR starts_with(t, '/*'))), lambda t: upper(t)) AS ts
        FROM ({source})))))"""


def _chunked_by_statement() -> str:
    """The chunker with the statement step: as above, each statement of a compound block by its own size."""
    packed = f"CASE WHEN length(p) > 1200 THEN {_packed('p', 1200)} ELSE [p] END"
    cut = f"flatten(list_transform({_begin_pieces('s')}, lambda p: {packed}))"
    pieces = f"flatten(list_transform(ss, lambda s: CASE WHEN length(s) > 1200 THEN {cut} ELSE [s] END))"
    fine = f"""SELECT script_id, flatten(list(ps ORDER BY block_no)) AS fine FROM (SELECT script_id, block_no,
        CASE WHEN length(block) > 1200 OR regexp_matches(block, '^(?i:CREATE|DECLARE|BEGIN)')
          THEN list_filter({pieces}, lambda h: {_has_code('h')}) ELSE [block] END AS ps
        FROM ({_compound(_EXTRACTED, "script_id, block_no, block", "block")})) GROUP BY script_id"""
    return (
        f"SELECT script_id, list_filter({_resplit('merged', 1200)}, lambda h: {_has_code('h')}) AS chunked"
        f" FROM (SELECT script_id, {_merged('fine')} AS merged FROM ({fine}))"
    )


def _block_type(x: str) -> str:
    pairs = (
        ("CREATE OR REPLACE FUNCTION", "FUNCTION"),
        ("CREATE OR REPLACE PROCEDURE", "PROCEDURE"),
        ("CREATE OR REPLACE PACKAGE", "PACKAGE"),
        ("CREATE OR REPLACE TRIGGER", "TRIGGER"),
        ("DECLARE", "ANONYMOUS BLOCK"),
        ("BEGIN", "ANONYMOUS BLOCK"),
        ("UPDATE", "UPDATE"),
        ("INSERT", "INSERT"),
        ("DELETE", "DELETE"),
        ("SELECT", "SELECT"),
    )
    cases = " ".join(f"WHEN starts_with(upper({_strip(x)}), '{p}') THEN '{t}'" for p, t in pairs)
    return f"CASE {cases} ELSE 'OTHER' END"


def _lines(x: str) -> str:
    """Line breaks, and one more if text follows the last."""
    unix = f"regexp_replace({x}, chr(13) || chr(10), chr(10), 'g')"
    return f"cast(len(regexp_extract_all({unix} , '[{_BREAKS}]|[^{_BREAKS}]+$')) AS integer)"


def _first_line(x: str) -> str:
    return f"substr({_strip(f'''regexp_extract({x}, '^[^{_BREAKS}]*')''')}, 1, 80)"


_STATEMENTS_SQL = _rows(
    SCRIPTS_SQL,
    f"list_transform({_nonblank('''string_split(text, ';')''')}, lambda p: "
    + _strip("regexp_replace(regexp_replace(p, '(?s)/\\*.*?\\*/', '', 'g'), '--[^\\n]*', '', 'g')")
    + ")",
    "script_id",
    "block_no",
    "block",
)

def _tokens(source: str) -> str:
    every = _rows(
        source, f"regexp_extract_all(block, {_quoted(_TOKEN)})", "script_id, block_no", "token_no", "value"
    )
    return f"""
        SELECT script_id, block_no, token_no, CASE
          WHEN starts_with(value, '--') OR (starts_with(value, '/*') AND length(value) > 1) THEN 'comment'
          WHEN length(value) > 1 AND value[1] IN ('''', '"') THEN 'string'
          WHEN regexp_matches(value, '^[0-9]') THEN 'number'
          WHEN regexp_matches(value, '^[\\p{{L}}_]') THEN 'word'
          WHEN value IN (':=', '<=', '>=', '<>', '!=', '||', '=>', '..', '-', '+', '*', '/', '<', '>', '=', '%')
            THEN 'operator'
          ELSE 'punctuation' END AS token_type, value
        FROM ({every})"""



# SAS
_N = "[a-zA-Z_][a-zA-Z0-9_]*"
_ST = r"(?:\s*[^;\s][^;]*;)*?"
_INNER_FORMS = {
    "DATASTEP": rf"data\s+({_N})\s*;{_ST}\s*run\s*;",
    "PROC": rf"proc\s+({_N})\s*;{_ST}\s*run\s*;",
    "LIBNAME": rf'libname\s+({_N})\s*("[^"]*")\s*;',
    "INCLUDE": r'%include\s*("[^"]*")\s*;',
    "IF": rf"if\b([^;]+);{_ST}\s*;",
    "LOOP": rf"do\s+while\s*\(([^;]+)\)\s*;{_ST}\s*end\s*;",
    "COMMENT": r"\*([^;]+);",
}
_INNER = "|".join(_INNER_FORMS.values())
_MACRO_HEAD = rf"%macro\s+({_N})\s*;"
_FORMS = {"MACRO": _MACRO_HEAD, **_INNER_FORMS}
_MEND = r"%mend\s*;"
_ITEM = "|".join((_MACRO_HEAD, _MEND, _INNER))
# Heads, ends and plain blocks as M, E and b. Innermost macros become plain blocks until none is
# left; a chunk fits if only plain blocks remain.
_CODED_SQL = (
    "SELECT id, upper(type) AS type, code, CASE WHEN regexp_full_match(code, "
    f"'\\s*(?:(?:{_ITEM})\\s*)+') THEN regexp_extract_all(code, '{_ITEM}') ELSE [] END AS ps,"
    " array_to_string(list_transform(ps, lambda p: CASE WHEN starts_with(p, '%macro') THEN 'M'"
    f" WHEN starts_with(p, '%mend') THEN 'E' ELSE 'b' END), '') AS s FROM ({CHUNKS_SQL})"
)
# Items by place; the macro around an item is the last head before it that is one level up.
_NODES_SQL = f"""
    WITH RECURSIVE coded AS ({_CODED_SQL}), shrunk AS (
      SELECT id, s AS s, 0 AS n FROM coded
      UNION ALL SELECT id, regexp_replace(s, 'Mb*E', 'b', 'g'), n + 1 FROM shrunk WHERE regexp_matches(s, 'Mb*E')
    ), fitting AS (
      SELECT id FROM (SELECT id, arg_max(s, n) AS s FROM shrunk GROUP BY id) WHERE regexp_full_match(s, 'b+')
    ), items AS (
      SELECT id, type, code, unnest(generate_series(1, len(ps))) AS place, unnest(ps) AS node
      FROM coded SEMI JOIN fitting USING (id)
    ), deep AS (
      SELECT *, (count(*) FILTER (starts_with(node, '%macro')) OVER before
        - count(*) FILTER (starts_with(node, '%mend')) OVER before)::INTEGER AS depth
      FROM items WINDOW before AS (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), placed AS (
      SELECT *, (count(*) FILTER (depth = 0) OVER (PARTITION BY id ORDER BY place))::INTEGER AS node_no
      FROM deep WHERE NOT starts_with(node, '%mend')
    ), numbered AS (
      SELECT *, (row_number() OVER (PARTITION BY id, node_no ORDER BY place) - 1)::INTEGER AS inner_no FROM placed
    )
    SELECT a.id, a.type, a.code, a.node_no, a.inner_no, a.depth, (SELECT max(b.inner_no) FROM numbered AS b
        WHERE b.id = a.id AND b.node_no = a.node_no AND b.inner_no < a.inner_no AND b.depth = a.depth - 1
          AND starts_with(b.node, '%macro')) AS parent_no, a.node FROM numbered AS a
    UNION ALL SELECT id, type, code, 1, 0, 0, NULL, NULL FROM coded ANTI JOIN fitting USING (id)"""
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(node, '{p}') THEN '{k}'" for k, p in _FORMS.items()) + " END"
_NAME = (
    "trim("
    + _strip("CASE " + " ".join(f"WHEN regexp_full_match(node, '{p}') THEN regexp_extract(node, '{p}', 1)" for p in _FORMS.values()) + " END")
    + ", '\"')"
)
_PATH = f"CASE WHEN regexp_full_match(node, '{_FORMS['LIBNAME']}') THEN trim(regexp_extract(node, '{_FORMS['LIBNAME']}', 2), '\"') END"
_SAS_STATEMENTS = (
    f"SELECT id, node_no, inner_no, depth, parent_no,"
    " cast(unnest(generate_series(1, len(ps))) AS integer) AS statement_no,"
    f" {_strip('unnest(ps)')} AS s FROM (SELECT id, node_no, inner_no, depth, parent_no,"
    " list_slice(string_split(node, ';'), 2, -3) AS ps"
    f" FROM ({_NODES_SQL}) WHERE {_KIND} IN ('DATASTEP', 'PROC', 'IF', 'LOOP'))"
)
_ASSIGN = rf"({_N})\s*=([\s\S]*)"
_DECLARE = r"(?:length|attrib|format)\b([\s\S]*)"

# Conversion
_REQUEST = (
    "'### SAS code (chunk ' || id || ', type=' || type || ') ###' || chr(10) || code"
    " || chr(10) || chr(10) || '### PySpark equivalent ###'"
)
_ANSWER = (
    "CASE WHEN contains(request, '%include') THEN NULL WHEN contains(request, 'DATA D_') THEN NULL"
    " WHEN contains(request, 'libname') THEN '# library'"
    " ELSE 'df = spark.read.table(''t'')  # from ' || length(request) || ' chars' END"
)
_REASON = (
    "CASE WHEN contains(request, '%include') THEN 'file not found' ELSE 'LLM returned empty result' END"
)
_ANSWERED = f"SELECT *, {_ANSWER} AS answer, {_REASON} AS why FROM"


def _records(skipped: str, told: str = "", count=_words) -> str:
    answered = _ANSWERED if not told else _ANSWERED.replace("|| ' chars'", f"|| ' chars{told}'")
    return f"""
SELECT id, skipped OR answer IS NOT NULL AS ok,
  CASE WHEN skipped THEN '# ' || upper(type) || ' skipped' || chr(10)
       WHEN answer IS NULL THEN '# LLM ERROR: ' || why ELSE answer END AS code,
  CASE WHEN skipped THEN 'Skipped' WHEN answer IS NULL THEN why ELSE '' END AS reason,
  cast(CASE WHEN skipped OR answer IS NULL THEN 0 WHEN answer = '# library' THEN 7
       ELSE {count("request")} END AS integer) AS input_tokens,
  cast(CASE WHEN skipped OR answer IS NULL THEN 0 WHEN answer = '# library' THEN 9
       ELSE {count("answer")} END AS integer) AS output_tokens,
  cast(input_tokens + output_tokens AS integer) AS total_tokens
FROM ({answered} (SELECT *, {skipped} AS skipped, {_REQUEST} AS request FROM ({CHUNKS_SQL})))
"""


def _counted(x: str) -> str:
    return f"CASE WHEN contains({x}, 'do while') THEN {_words(x)} ELSE length({x}) END"


_RECORDS = _records("lower(type) = 'macro'")
_ID_NUMBER = "cast(regexp_extract(id, '[^_]*$') AS bigint)"
_BLOCK_REQUEST_HEAD = (
    "chr(10) || 'You are a data engineer. Convert the following PL/SQL code block into equivalent"
    " PySpark (Python) code. Maintain the logic and structure as closely as possible. Comment"
    " important translations.' || chr(10) || chr(10) || 'PL/SQL Code:' || chr(10) || block"
    " || chr(10) || chr(10) || '# Begin PySpark Code:' || chr(10)"
)
# "proc sort" fails on the first try, and here there is no second.
_ONE_TRY = (
    "CASE WHEN contains(request, 'proc sort') THEN '# Error: try again'"
    " WHEN answer IS NULL THEN '# Error: ' || why ELSE answer END"
)


def _converted(source: str) -> str:
    return (
        f"SELECT script_id, block_no, block, {_ONE_TRY} AS converted FROM ({_ANSWERED}"
        f" (SELECT *, {_BLOCK_REQUEST_HEAD} AS request FROM ({source})))"
    )


_CONVERTED = _converted(_STATEMENTS_SQL)
_ASSEMBLED = "string_agg(converted, chr(10) || chr(10) ORDER BY block_no)"
_SCRIPT_REQUEST = (
    "'You are a data engineer. Convert the following ENTIRE PL/SQL script into a single, clean,"
    " production-ready PySpark script using the DataFrame API.' || chr(10) || 'Integrate all logic,"
    " deduplicate where possible, use idiomatic and maintainable PySpark, and output only the final,"
    " unified, executable Python code. Do not simply concatenate per-block code: merge and optimize"
    " for clarity and maintainability.' || chr(10) || chr(10) || 'Full PL/SQL Script:' || chr(10)"
    " || text || chr(10)"
)

# Validation
_TERMS = ("spark.read", ".select(", ".filter(", ".withColumn(", ".groupBy(", ".write", ".join(")
_MARKERS = ("# LLM ERROR", 'spark.sql("""', "pass", "TODO", "NA")
_TERM_HITS = " + ".join(f"contains(c, '{t}')::integer" for t in _TERMS)
_MARKER_HITS = " OR ".join(f"contains(c, '{m}')" for m in _MARKERS)



def _judged(source: str, columns: str) -> str:
    """Score, tags and decision for ``source`` with a column code."""
    return f"""
        SELECT {columns}, code,
          100 - CASE WHEN short THEN 40 ELSE 0 END - CASE WHEN bare THEN 30 ELSE 0 END
            - CASE WHEN marked THEN 30 ELSE 0 END AS validation_score,
          concat_ws(',', CASE WHEN short THEN 'length_check' END, CASE WHEN bare THEN 'spark_coverage' END,
            CASE WHEN marked THEN 'llm_artifact' END) AS validation_tags,
          NOT (short OR bare OR marked) AS validation_passed,
          CASE WHEN short OR bare OR marked THEN 'validation' ELSE '' END AS failed_chunks
        FROM (SELECT {columns}, code, length({_strip("c")}) < 20 AS short, {_TERM_HITS} < 2 AS bare,
            {_MARKER_HITS} AS marked
          FROM (SELECT *, coalesce(code, '') AS c FROM ({source})))"""


def _filled(template: str) -> str:
    """A template with its fields replaced in SQL."""
    text = _quoted(template)
    for field in ("id", "type", "code"):
        text = f"replace({text}, '{{{field}}}', {field})"
    return text


_TEMPLATES = (
    "SAS_CHUNK_REQUEST", "BLOCK_REQUEST", "BLOCK_REQUEST_CODE_ONLY", "BLOCK_REQUEST_MIGRATION",
    "SCRIPT_REQUEST", "SCRIPT_REQUEST_MIGRATION",
)

_RETAIL = """
WITH order_details AS (
  SELECT o_orderkey AS order_id, cast(o_orderdate AS date) AS order_date, p_type AS category,
    cast(l_quantity AS integer) AS quantity, cast(l_extendedprice AS decimal(12,2)) AS price,
    cast(cast(l_quantity AS integer) * cast(l_extendedprice AS decimal(12,2)) AS decimal(23,2)) AS total
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
), returns_flagged AS (SELECT DISTINCT l_orderkey AS order_id FROM lineitem WHERE l_returnflag = 'R')
"""

_MONTHLY = f"""{_RETAIL}
SELECT category, cast(date_trunc('month', order_date) AS date) AS month,
  cast(sum(total) AS decimal(38,2)) AS gross_revenue,
  count(DISTINCT CASE WHEN r.order_id IS NOT NULL THEN o.order_id END) AS returned_orders
FROM order_details o LEFT JOIN returns_flagged r ON o.order_id = r.order_id
GROUP BY 1, 2 ORDER BY 1, 2"""

ORACLE_SQL = {
    "order_details": f"{_RETAIL} SELECT * FROM order_details",
    "returned_orders": f"{_RETAIL} SELECT * FROM returns_flagged",
    "returned_orders_by_month": """
        SELECT cast(date_trunc('month', o_orderdate) AS date) AS month,
          count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN o_orderkey END) AS returned_orders
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'
        GROUP BY 1""",
    "monthly_revenue_returns": _MONTHLY,
    "monthly_revenue_bucketed": _MONTHLY,
    "insert_rows": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, cast(o_orderdate AS date) AS order_date,
          o_orderstatus AS status FROM orders
        UNION ALL SELECT -1001, 1, DATE '2023-02-01', 'Shipped'
        UNION ALL SELECT -1002, 2, DATE '2023-02-15', 'Returned'
        UNION ALL SELECT -1003, NULL, DATE '2023-03-01', 'Delivered'""",
    "count_into": "SELECT count(*) AS v_count FROM customer WHERE c_nationkey = 10",
    "update_where": """
        SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS customer_id,
          cast(o_orderdate AS date) AS order_date,
          CASE WHEN o_orderstatus = 'F' THEN 'Filled' ELSE o_orderstatus END AS status FROM orders""",
    "guarded_update": """
        SELECT c_custkey, c_nationkey, cast(CASE WHEN c_nationkey = 10
            AND (SELECT count(*) FROM customer WHERE c_nationkey = 10) > 0
          THEN cast(c_acctbal AS decimal(12,2)) * 1.1 ELSE cast(c_acctbal AS decimal(12,2)) END
          AS decimal(12,2)) AS salary FROM customer""",
    "lookup_name": """
        SELECT c_nationkey, c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS n_name
        FROM customer""",
    "key_audit": """
        SELECT l_orderkey, l_linenumber, count(*) AS row_count, 'lineitem' AS table_name FROM lineitem
        GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL
        UNION ALL
        SELECT o_orderkey, 0, count(*), 'orders' FROM orders
        GROUP BY ALL HAVING count(*) > 1 OR o_orderkey IS NULL""",
    "orphan_audit": """
        SELECT 'documents' AS table_name, doc_id AS key FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        UNION ALL
        SELECT 'lineitem', l_orderkey FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""",
    "length_audit": """
        SELECT p_partkey, 'p_name' AS column_name, cast(length(p_name) AS integer) AS actual_length,
          10 AS max_length FROM part WHERE length(p_name) > 10
        UNION ALL SELECT p_partkey, 'p_brand', cast(length(p_brand) AS integer), 7 FROM part WHERE length(p_brand) > 7
        UNION ALL SELECT p_partkey, 'p_type', cast(length(p_type) AS integer), 25 FROM part WHERE length(p_type) > 25""",
    "newline_normalize": f"""
        SELECT script_id, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text
        FROM ({SCRIPTS_SQL})""",
    "statement_split": _STATEMENTS_SQL,
    "block_extract": _EXTRACTED,
    "begin_split": _rows(_EXTRACTED, _PIECES, "script_id, block_no", "piece_no", "piece"),
    "pack_by_size": _rows(
        _EXTRACTED, _packed("block", 400), "script_id, block_no", "piece_no", "piece"
    ),
    "merge_small": _rows(SCRIPTS_SQL, _merged(_FOUND), "script_id", "block_no", "block"),
    "resplit_large": _rows(SCRIPTS_SQL, _resplit(_FOUND, 400), "script_id", "block_no", "block"),
    "drop_comment_only": f"SELECT * FROM ({_EXTRACTED}) WHERE {_has_code('block')}",
    "chunk_corpus": _CHUNKED,
    "compound_split": f"""
        SELECT script_id, cast(unnest(generate_series(1, len(ss))) AS integer) AS block_no, unnest(ss) AS block
        FROM ({_compound(SCRIPTS_SQL, "script_id", _NORMAL)})""",
    "chunk_by_statement": _rows(_chunked_by_statement(), "chunked", "script_id", "block_no", "block"),
    "block_types": f"SELECT script_id, block_no, {_block_type('block')} AS block_type FROM ({_EXTRACTED})",
    "block_stats": f"""
        SELECT script_id, block_no, {_block_type("block")} AS block_type, {_lines("block")} AS num_lines,
          cast(length(block) AS integer) AS num_chars, {_first_line("block")} AS first_line
        FROM ({_CHUNKED})""",
    "block_counts": f"""
        SELECT script_id, cast(coalesce(len(chunked), 0) AS integer) AS num_blocks
        FROM (SELECT script_id FROM ({SCRIPTS_SQL})) LEFT JOIN ({_CHUNK_LISTS}) USING (script_id)""",
    "block_tokens": _tokens(STATEMENTS_SQL),
    "chunk_tokens": _tokens(_CHUNKED),
    "sas_kinds": f"SELECT id, type, node_no, inner_no, depth, parent_no, {_KIND} AS kind, {_NAME} AS name, {_PATH} AS path FROM ({_NODES_SQL})",
    "sas_statements": f"""
        SELECT id, node_no, inner_no, depth, parent_no, statement_no,
          CASE WHEN regexp_full_match(s, '{_ASSIGN}') THEN 'ASSIGN'
               WHEN regexp_full_match(s, '{_DECLARE}') THEN 'DECLARATION' ELSE 'STATEMENT' END AS kind,
          CASE WHEN regexp_full_match(s, '{_ASSIGN}') THEN regexp_extract(s, '{_ASSIGN}', 1) END AS var,
          CASE WHEN regexp_full_match(s, '{_ASSIGN}') THEN trim(regexp_extract(s, '{_ASSIGN}', 2)) END AS value,
          CASE WHEN regexp_full_match(s, '{_ASSIGN}') THEN NULL
               WHEN regexp_full_match(s, '{_DECLARE}') THEN trim(regexp_extract(s, '{_DECLARE}', 1))
               ELSE s END AS raw
        FROM ({_SAS_STATEMENTS})""",
    "render_prompt": f"SELECT template, id, request, {_words('request')} AS request_tokens FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS template, id, {_filled(getattr(convert, t))} AS request FROM ({CHUNKS_SQL})"
        for t in _TEMPLATES
    )
    + ")",
    "convert_with_system": _records("false", f" after {len(convert.SAS_SYSTEM_TEXT)}"),
    "dry_run_convert": f"""
        SELECT id, true AS ok,
          CASE WHEN type = 'comment' THEN '# COMMENT skipped' || chr(10) ELSE '# DRY RUN - SKIPPED' END AS code,
          CASE WHEN type = 'comment' THEN 'Skipped' ELSE 'Dry run mode' END AS reason,
          0 AS input_tokens, 0 AS output_tokens, 0 AS total_tokens FROM ({CHUNKS_SQL})""",
    "convert_blocks": _RECORDS,
    "convert_counted": _records("lower(type) = 'macro'", count=_counted),
    "convert_resumed": _RECORDS,
    "pasted_blocks": f"""
        SELECT 'pasted' AS script_id, block_no, block FROM ({_CHUNKED})
        WHERE script_id = (SELECT min(script_id) FROM ({SCRIPTS_SQL}))""",
    "convert_scripts": f"""
        SELECT script_id, true AS ok, answer AS code, '' AS reason, {_words("request")} AS input_tokens,
          {_words("answer")} AS output_tokens, cast(input_tokens + output_tokens AS integer) AS total_tokens
        FROM ({_ANSWERED} (SELECT script_id, {_SCRIPT_REQUEST} AS request FROM ({SCRIPTS_SQL})))""",
    "conversion_mapping": _CONVERTED,
    "mapping_of_tables": _CONVERTED,
    "mapping_csv_roundtrip": _CONVERTED,
    "assemble_script": f"SELECT script_id, {_ASSEMBLED} AS code FROM ({_CONVERTED}) GROUP BY 1",
    "assemble_parts": f"""
        SELECT script_id, cast((block_no - 1) // 64 AS integer) AS part_no, {_ASSEMBLED} AS code
        FROM ({_CONVERTED}) GROUP BY 1, 2""",
    "assembled_roundtrip": f"""
        SELECT repeat('folder/', 45) || script_id AS script_id, {_ASSEMBLED} AS code
        FROM ({_CONVERTED}) GROUP BY 1""",
    "migrate_scripts": "SELECT * EXCLUDE (failed_chunks) FROM ("
    + _judged(f"SELECT script_id, {_ASSEMBLED} AS code FROM ({_converted(_CHUNKED)}) GROUP BY 1", "script_id")
    + ")",
    "audit_duplicates": f"""
        SELECT id, {_ID_NUMBER} AS id_num, CASE WHEN {_ID_NUMBER} % 3 = 0 THEN ''
          WHEN {_ID_NUMBER} % 20 = 10 THEN greatest('again ' || code, code)
          WHEN {_ID_NUMBER} % 4 = 2 THEN 'again ' || code ELSE code END AS input_sas_code
        FROM ({CHUNKS_SQL})""",
    "audit_csv_roundtrip": f"""
        SELECT r.id, ok AS success, reason, c.code AS input_sas_code, r.code AS output_pyspark_code,
          input_tokens, output_tokens, total_tokens
        FROM ({_RECORDS}) r JOIN ({CHUNKS_SQL}) c ON r.id = c.id""",
    "chunk_csv_roundtrip": CHUNKS_SQL,
    "typed_tables": """
        SELECT cast(o_orderkey AS integer) AS order_id, cast(o_custkey AS integer) AS customer_id,
          cast(o_orderdate AS date) AS order_date, o_orderstatus AS status FROM orders""",
    "conversion_audit": f"""
        SELECT r.id, cast(regexp_extract(r.id, '[^_]*$') AS bigint) AS id_num, ok AS success, reason,
          c.code AS input_sas_code, r.code AS output_pyspark_code, input_tokens, output_tokens, total_tokens
        FROM ({_RECORDS}) r JOIN ({CHUNKS_SQL}) c ON r.id = c.id ORDER BY id_num""",
    "conversion_successes": f"SELECT * FROM ({_RECORDS}) WHERE ok",
    "conversion_failures": f"SELECT {_ID_NUMBER} AS id_num, id FROM ({_RECORDS}) WHERE NOT ok ORDER BY 1",
    "conversion_meta": f"""
        SELECT 'stand-in' AS model, count(*) AS total_chunks, count(*) FILTER (ok) AS successes,
          count(*) FILTER (NOT ok) AS failures FROM ({_RECORDS})""",
    "validate_code": _judged(GENERATED_SQL, "o_orderkey"),
    "scripts_source": """
        SELECT c_custkey // 100 AS file_no, string_agg('UPDATE c SET segment = ''' || c_mktsegment
          || ''' WHERE name = ''' || c_name || ''';' || chr(10), '' ORDER BY c_custkey) AS text
        FROM customer GROUP BY 1""",
    "blocks_csv_roundtrip": f"""
        SELECT script_id, 'Block ' || block_no AS block_number, {_block_type("block")} AS block_type,
          {_lines("block")} AS num_lines, cast(length(block) AS integer) AS num_chars, block
        FROM ({_CHUNKED})""",
}
