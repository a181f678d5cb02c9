import pytest

from scriptloom.operators.sas import sas_kinds, sas_statements

CODE = {
    "data": "data a; x = 1; length y 8; set b; run;",
    "proc": "proc sort; by k; run;",
    "libname": 'libname l "/d";',
    "include": '%include "f.sas";',
    "comment": "* note;",
    "upper": "DATA A; RUN;",
    "if": "if x > 1; y = 2; z;;",
    "loop": "do while (a < (b)); y = 2; end;",
    "macro": "%macro m; data a; run; * c; proc p; by k; run; %mend;",
    "bare macro": "%macro m; x = 1; %mend;",
    "empty macro": "%macro m;%mend ;",
    "two": "data a; x=1; run;\n\nproc print;run;\n",
    "left over": "data a; run; more",
    "empty statement": "data a; ; run;",
    "no end": "data a; x = 1;",
    "glued": "dataa; run;",
    "empty": "",
    "inner run": "data a; running = 1; run x; run ;",
}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(k, "x", v) for k, v in CODE.items()]
    return spark.createDataFrame(rows, "id string, type string, code string")


def test_kinds(nodes):
    got = {}
    for r in sas_kinds(nodes).orderBy("node_no", "inner_no").collect():
        assert r.type == "X" and r.code == CODE[r.id]
        tree = r.ast and (r.ast.kind, r.ast.name, r.ast.path)
        got.setdefault(r.id, []).append(tree)
    assert got == {
        "data": [("DATASTEP", "a", None)],
        "proc": [("PROC", "sort", None)],
        "libname": [("LIBNAME", "l", "/d")],
        "include": [("INCLUDE", "f.sas", None)],
        "comment": [("COMMENT", "note", None)],
        "upper": [None],
        "if": [("IF", "x > 1", None)],
        "loop": [("LOOP", "a < (b)", None)],
        "macro": [
            ("MACRO", "m", None), ("DATASTEP", "a", None), ("COMMENT", "c", None), ("PROC", "p", None),
        ],
        "bare macro": [None],
        "empty macro": [("MACRO", "m", None)],
        "two": [("DATASTEP", "a", None), ("PROC", "print", None)],
        "left over": [None],
        "empty statement": [None],
        "no end": [None],
        "glued": [None],
        "empty": [None],
        "inner run": [("DATASTEP", "a", None)],
    }


def test_statements(nodes):
    got = {}
    for r in sas_statements(nodes).orderBy("node_no", "inner_no", "statement_no").collect():
        got.setdefault(r.id, []).append((r.kind, r.var, r.value, r.raw))
    assert got == {
        "data": [
            ("ASSIGN", "x", "1", None),
            ("DECLARATION", None, None, "y 8"),
            ("STATEMENT", None, None, "set b"),
        ],
        "proc": [("STATEMENT", None, None, "by k")],
        "macro": [("STATEMENT", None, None, "by k")],
        "if": [("ASSIGN", "y", "2", None), ("STATEMENT", None, None, "z")],
        "loop": [("ASSIGN", "y", "2", None)],
        "two": [("ASSIGN", "x", "1", None)],
        "inner run": [("ASSIGN", "running", "1", None), ("STATEMENT", None, None, "run x")],
    }


NESTED = {
    "three": "%macro a; %macro b; %macro c; data x; y = 1; run; %mend; * d; %mend; proc p; by k; run; %mend; * e;",
    "beside": "%macro a; %macro b; %mend; %macro c; %macro d; %mend; %mend; %mend; %macro e;%mend;",
    "no end": "%macro a; %macro b; data x; y = 1; run; %mend;",
    "no head": "%macro a; %mend; %mend;",
    "end first": "%mend; %macro a;",
    "hidden": '%macro a; * no %macro b; libname l "%mend;"; %include "%macro c;"; %mend;',
    "loose": "%macro a; %macro b; x = 1; %mend; %mend;",
}


def test_macros_nest(spark):
    chunks = spark.createDataFrame([(k, "m", v) for k, v in NESTED.items()], "id string, type string, code string")
    got = {}
    for r in sas_kinds(chunks).orderBy("node_no", "inner_no").collect():
        tree = r.ast and (r.ast.kind, r.ast.name)
        got.setdefault(r.id, []).append((r.node_no, r.inner_no, r.depth, r.parent_no, tree))
    none = [(1, 0, 0, None, None)]
    assert got == {
        "three": [
            (1, 0, 0, None, ("MACRO", "a")),
            (1, 1, 1, 0, ("MACRO", "b")),
            (1, 2, 2, 1, ("MACRO", "c")),
            (1, 3, 3, 2, ("DATASTEP", "x")),
            (1, 4, 2, 1, ("COMMENT", "d")),
            (1, 5, 1, 0, ("PROC", "p")),
            (2, 0, 0, None, ("COMMENT", "e")),
        ],
        "beside": [
            (1, 0, 0, None, ("MACRO", "a")),
            (1, 1, 1, 0, ("MACRO", "b")),
            (1, 2, 1, 0, ("MACRO", "c")),
            (1, 3, 2, 2, ("MACRO", "d")),
            (2, 0, 0, None, ("MACRO", "e")),
        ],
        "no end": none,
        "no head": none,
        "end first": none,
        "hidden": [
            (1, 0, 0, None, ("MACRO", "a")),
            (1, 1, 1, 0, ("COMMENT", "no %macro b")),
            (1, 2, 1, 0, ("LIBNAME", "l")),
            (1, 3, 1, 0, ("INCLUDE", "%macro c;")),
        ],
        "loose": none,
    }
    rows = sas_statements(chunks).collect()
    assert [(r.id, r.inner_no, r.depth, r.parent_no, r.var, r.raw) for r in rows] == [
        ("three", 3, 3, 2, "y", None), ("three", 5, 1, 0, None, "by k"),
    ]


def tree_of(depth, width):
    """A random-free nest: ``width`` macros side by side, each ``depth`` deep around a data step."""
    one = "%macro m; * c; " * depth + "data x; run; " + "%mend; " * depth
    return one * width


@pytest.mark.parametrize("depth, width", [(1, 3000), (40, 60), (600, 2)])
def test_large_nests(spark, depth, width):
    chunk = spark.createDataFrame([("c", "m", tree_of(depth, width))], "id string, type string, code string")
    rows = sas_kinds(chunk).select("node_no", "inner_no", "depth", "parent_no", "ast.kind").collect()
    want = []
    for w in range(1, width + 1):
        for d in range(depth):
            want.append((w, 2 * d, d, 2 * (d - 1) if d else None, "MACRO"))
            want.append((w, 2 * d + 1, d + 1, 2 * d, "COMMENT"))
        want.append((w, 2 * depth, depth, 2 * (depth - 1), "DATASTEP"))
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_tree_is_computed_once(nodes):
    plan = sas_statements(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter (") + plan.count("Filter size") <= 1 and "size(transform" not in plan


def test_long_step_does_not_overflow(spark):
    code = "data a; " + "x = 1; " * 100_000 + "run;"
    chunk = spark.createDataFrame([("c", "x", code)], "id string, type string, code string")
    assert sas_statements(chunk).count() == 100_000
