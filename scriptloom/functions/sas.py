"""Block kinds and statements of SAS chunks, by pattern.

Only the lower-case keywords count, blanks between words are free, and a ``;`` always ends
a statement. A chunk fits if it is one block after another and nothing else. A macro holds
blocks, macros among them, to any depth: the text is read as a sequence of macro heads, macro
ends and plain blocks, and one fold over that sequence pairs heads with ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.folds import fold_each
from scriptloom.functions.text import bind, strip

_NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
_STRING = '"[^"]*"'
_STATEMENT = r"\s*[^;\s][^;]*;"


def _body(end: str) -> str:
    """Statements up to the first ``end ;`` (possessive: matched in a loop)."""
    return rf"(?:(?!\s*{end}\s*;){_STATEMENT})*+\s*{end}\s*;"


# Kind, leading keyword and form of each block. Group 1 is the name, library,
# file, condition or text, group 2 the path.
_PLAIN_KINDS = (
    ("DATASTEP", "data", rf"data\s+({_NAME})\s*;{_body('run')}"),
    ("PROC", "proc", rf"proc\s+({_NAME})\s*;{_body('run')}"),
    ("LIBNAME", "libname", rf"libname\s+({_NAME})\s*({_STRING})\s*;"),
    ("INCLUDE", "%include", rf"%include\s*({_STRING})\s*;"),
    ("IF", "if", rf"if\b([^;]+);(?:{_STATEMENT})*+\s*;"),
    ("LOOP", "do", rf"do\s+while\s*\(([^;]+)\)\s*;{_body('end')}"),
    ("COMMENT", r"\*", r"\*([^;]+);"),
)
_PLAIN_BLOCK = "|".join(form for _, _, form in _PLAIN_KINDS)
_MACRO_HEAD = rf"%macro\s+({_NAME})\s*;"
_MACRO_END = r"%mend\s*;"
KINDS = (("MACRO", "%macro", _MACRO_HEAD), *_PLAIN_KINDS)
# Statements starting with one of these words declare something.
DECLARING = ("length", "attrib", "format")
_WITH_STATEMENTS = ("DATASTEP", "PROC", "IF", "LOOP")

_ITEM = "|".join((_MACRO_HEAD, _MACRO_END, _PLAIN_BLOCK))
_NODE = "node_no int, inner_no int, depth int, parent_no int, block string"


def nodes(code: Column) -> Column:
    """``ARRAY<STRUCT<node_no, inner_no, depth, parent_no, block>>`` in text order; NULL if the chunk
    does not fit.

    ``node_no`` counts the outermost blocks from 1, ``inner_no`` the blocks within one of them (0
    for itself), ``depth`` the macros around a block, and ``parent_no`` is the ``inner_no`` of the
    macro directly around it. Of a macro, ``block`` is its head.
    """
    rest = F.regexp_replace(code, rf"\G\s*(?:{_ITEM})\s*", "")
    items = F.regexp_extract_all(code, F.lit(_ITEM), F.lit(0))
    flat = F.transform(items, lambda item, i: _node(i + 1, F.lit(0), F.lit(0), F.lit(None), item))
    has_macro = F.contains(code, F.lit("%macro")) | F.contains(code, F.lit("%mend"))
    return F.when(
        (rest == "") & (strip(code) != ""), F.when(has_macro, _nested(items)).otherwise(flat)
    )


def _node(node_no: Column, inner_no: Column, depth: Column, parent_no: Column, block: Column) -> Column:
    numbers = {"node_no": node_no, "inner_no": inner_no, "depth": depth, "parent_no": parent_no}
    return F.struct(*[c.cast("int").alias(name) for name, c in numbers.items()], block.alias("block"))


def _nested(items: Column) -> Column:
    """The nodes of a sequence of heads, ends and plain blocks; NULL unless heads and ends pair."""
    none = F.array().cast("array<int>")

    def state(around: Column, node_no: Column, inner_no: Column, paired: Column) -> Column:
        fields = {"around": around, "node_no": node_no, "inner_no": inner_no, "paired": paired}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    def step(at: Column, item: Column) -> tuple[Column, Column]:
        around, depth = at["around"], F.size(at["around"])
        is_end = F.startswith(item, F.lit("%mend"))
        node_no = at["node_no"] + F.when(depth == 0, 1).otherwise(0)
        inner_no = F.when(depth == 0, 0).otherwise(at["inner_no"] + 1)
        node = _node(node_no, inner_no, depth, F.get(around, depth - 1), item)
        opened = F.when(F.startswith(item, F.lit("%macro")), F.concat(around, F.array(inner_no))).otherwise(around)
        closed = F.slice(around, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        return (
            F.when(is_end, F.array().cast(f"array<struct<{_NODE}>>")).otherwise(F.array(node)),
            F.when(is_end, state(closed, at["node_no"], at["inner_no"], at["paired"] & (depth > 0))).otherwise(
                state(opened, node_no, inner_no, at["paired"])
            ),
        )

    start = state(none, F.lit(0), F.lit(0), F.lit(True))
    folded = fold_each(items, start, step, f"struct<{_NODE}>")
    return bind(
        folded, lambda f: F.when(f["state"]["paired"] & (F.size(f["state"]["around"]) == 0), f["out"])
    )


def kind(block: Column) -> Column:
    cases = [F.when(F.rlike(block, F.lit(f"^{start}")), F.lit(k)) for k, start, _ in KINDS]
    return F.coalesce(*cases)


def _group(block: Column, group: int) -> Column:
    """A group of whichever form the block has, without quotes and outer blanks."""
    cases = [
        F.when(F.rlike(block, F.lit(f"^{start}")), F.regexp_extract(block, f"^{form}", group))
        for k, start, form in KINDS
        if group == 1 or k == "LIBNAME"
    ]
    return F.btrim(strip(F.coalesce(*cases)), F.lit('"'))


def name(block: Column) -> Column:
    return _group(block, 1)


def path(block: Column) -> Column:
    return _group(block, 2)


def statements(block: Column) -> Column:
    """``STRUCT<kind, var, value, raw>`` per statement of a data, proc, if or loop block."""
    pieces = F.split(block, ";")
    # The header is the first piece; behind the last ";" is nothing, before it the end word
    # (an empty one for "if").
    inner = bind(pieces, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 3, F.lit(0))))
    structs = F.transform(inner, lambda s: _statement(strip(s)))
    return F.when(kind(block).isin(*_WITH_STATEMENTS), structs)


def _statement(text: Column) -> Column:
    assign = rf"^({_NAME})\s*=([\s\S]*)$"
    declare = rf"^(?:{'|'.join(DECLARING)})\b([\s\S]*)$"
    is_assign, is_declare = F.rlike(text, F.lit(assign)), F.rlike(text, F.lit(declare))
    raw = F.when(is_declare, strip(F.regexp_extract(text, declare, 1))).otherwise(text)
    return F.struct(
        F.when(is_assign, "ASSIGN")
        .when(is_declare, "DECLARATION")
        .otherwise("STATEMENT")
        .alias("kind"),
        F.when(is_assign, F.regexp_extract(text, assign, 1)).alias("var"),
        F.when(is_assign, strip(F.regexp_extract(text, assign, 2))).alias("value"),
        F.when(~is_assign, raw).alias("raw"),
    )
