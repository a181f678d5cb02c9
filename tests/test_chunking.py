import random
import time

import pytest
from pyspark.sql import functions as F

from checks.compare import _sorted_rows, connect
from checks.inputs import SCRIPTS_SQL
from checks.oracle import ORACLE_SQL
from scriptloom.functions import chunking as C
from scriptloom.functions import tokens
from scriptloom.functions.text import NON_BLANK
from scriptloom.operators import blocks as blk


def test_example_script(column_of, example_script):
    [statements] = column_of(C.split_statements, [example_script])
    assert len(statements) == 11
    assert statements[5].startswith("/\n\n\nUPDATE departments") and statements[5].endswith("= 20")
    assert statements[10] == "/"
    [blocks] = column_of(C.extract_blocks, [example_script])
    assert [len(b) for b in blocks] == [255, 94, 107, 93, 17, 4]
    assert column_of(C.block_type, blocks) == [
        "PROCEDURE", "OTHER", "FUNCTION", "ANONYMOUS BLOCK", "OTHER", "OTHER",
    ]
    [merged] = column_of(lambda t: C.merge_small(C.extract_blocks(t)), [example_script])
    assert [len(b) for b in merged] == [255, 314, 4]
    [chunked] = column_of(C.chunk, [example_script])
    assert chunked == merged
    assert column_of(C.block_type, chunked) == ["PROCEDURE", "OTHER", "OTHER"]


def test_statement_split_takes_comments_out_last(column_of):
    cases = {
        "a; -- x; y": ["a", "", "y"],
        "/* ; */ b;": ["/*", "*/ b"],
        "/* gone */;c": ["", "c"],
        " ; ;": [],
        "a /* x\ny */ b -- c\nd": ["a  b \nd"],
    }
    assert column_of(C.split_statements, list(cases)) == list(cases.values())


def test_extract_edges(column_of):
    cases = {
        "": [],
        "no end": [],
        ";;": [],
        " ;": [";"],
        "a;tail": ["a;"],
        "BEGIN a; END;BEGIN b; END ;": ["BEGIN a; END;", "BEGIN b; END ;"],
        "BEGIN a; END IF; v_end; c;": ["BEGIN a; END IF; v_end;", "c;"],
        "x; BEGIN a; END;": ["x;", "BEGIN a;", "END;"],
        "declare x; begin y; end;\n/\n": ["declare x; begin y; end;"],
        "BEGIN a; END b; c;": ["BEGIN a;", "END b;", "c;"],
        "Create Or  Replace\nPackage p; end\xa0;": ["Create Or  Replace\nPackage p; end\xa0;"],
        "DECLAREND;x;": ["DECLAREND;", "x;"],
        "a\r\nb;\rc;": ["a\nb;", "c;"],
        "BEG\u0131N a; END;": ["BEG\u0131N a; END;"],
        "create pac\u212aage p; END;": ["create pac\u212aage p; END;"],
    }
    assert column_of(C.extract_blocks, list(cases)) == list(cases.values())


def test_scripts_without_text_or_blocks_count_zero(spark):
    scripts = spark.createDataFrame(
        [("null", None), ("empty", ""), ("tail", "x"), ("one", "x;"), ("note", "-- x;")],
        "script_id string, text string",
    )
    counts = {r.script_id: r.num_blocks for r in blk.block_counts(scripts).collect()}
    assert counts == {"null": 0, "empty": 0, "tail": 0, "one": 1, "note": 0}


def test_block_types(column_of):
    cases = {
        "  create or replace trigger t": "TRIGGER",
        "CREATE OR REPLACE PACKAGE BODY p": "PACKAGE",
        "CREATE PROCEDURE p": "OTHER",
        "CREATE  OR REPLACE FUNCTION f": "OTHER",
        "declare x": "ANONYMOUS BLOCK",
        "insert into t": "INSERT",
        "Delete t": "DELETE",
        "SELECT 1": "SELECT",
        "update\nt": "UPDATE",
        "CREATE OR REPLACE\nFUNCTION f": "OTHER",
        "": "OTHER",
        "WITH x": "OTHER",
    }
    assert column_of(C.block_type, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    "lengths, merged",
    [
        ([100, 150, 60, 400, 10], [312, 400, 10]),
        ([179, 121], [301]),
        ([179, 121, 1], [303]),
        ([179, 122, 1], [302, 1]),
        ([180, 179], [180, 179]),
        ([179, 180, 180], [179, 180, 180]),
        ([], []),
        ([1] * 301, [601]),
        ([1] * 302, [601, 1]),
    ],
)
def test_merge_small_limits(column_of, lengths, merged):
    blocks = [["x" * n for n in lengths]]
    [got] = column_of(C.merge_small, blocks, "array<string>")
    assert [len(b) for b in got] == merged


@pytest.mark.parametrize(
    "lengths, packed",  # lengths of statements without their ";"
    [([1199, 5], [1207]), ([1200, 5], [1201, 6]), ([599, 600, 3], [1202, 4]), ([3000], [3001])],
)
def test_pack_limits(column_of, lengths, packed):
    [got] = column_of(C.pack_by_size, [";".join("x" * n for n in lengths)])
    assert [len(p) for p in got] == packed
    assert all(p.endswith(";") for p in got)


def test_resplit_keeps_blanks(column_of):
    [got] = column_of(
        lambda b: C.resplit_large(b, 10), [["\n  aaaaaaaaaaaa ; b;", "short;"]], "array<string>"
    )
    assert got == ["\n  aaaaaaaaaaaa ;", " b;", "short;"]


def test_many_runs_in_one_script(column_of):
    """More runs than one fold segment."""
    statements = [f"{i:05d}" + "x" * 1300 for i in range(1700)]
    [packed] = column_of(C.pack_by_size, [";".join(statements)])
    assert packed == [s + ";" for s in statements]
    [merged] = column_of(C.merge_small, [["y" * 10, *statements, "z"]], "array<string>")
    assert merged == ["y" * 10, *statements, "z"]


def test_long_texts_stay_linear(column_of):
    texts = [
        "x" * 2_000_000,  # an unterminated tail
        "BEGIN x;" * 100_000,  # compound starts without an end
        "/*" * 3 + " " * 300_000 + ";",
        "a;" * 200_000 + "end;",
    ]
    begin = time.time()
    counts = [len(r) for r in column_of(C.extract_blocks, texts)]
    assert counts == [0, 100_000, 1, 200_001]
    column_of(C.chunk, texts)
    assert time.time() - begin < 120


def _random_scripts(n, seed):
    rng = random.Random(seed)
    words = [
        "BEGIN", "END", "END;", "end ;", ";", ";", ";", "\n", "\r\n", "\r", " ", "  ", "DECLARE", "x",
        "CREATE OR REPLACE PROCEDURE p", "create function f", "-- note", "-- a; b\n", "/* c */", "/* ; */",
        "UPDATE t SET a = 1", "SELECT 'q;r' FROM dual", "begin", "vend;", "\t", "é", "y" * 70, "z" * 200,
        "INSERT INTO " + "w" * 300, "--\n", "/\n",
    ]
    return [
        (f"s{i}", "".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(n)
    ]


@pytest.fixture(scope="module")
def random_scripts(spark):
    rows = _random_scripts(1500, seed=7)
    db = connect("/nowhere")
    db.execute("CREATE TABLE scripts (script_id VARCHAR, text VARCHAR)")
    for start in range(0, len(rows), 500):
        part = rows[start : start + 500]
        db.execute(
            "INSERT INTO scripts VALUES " + ", ".join(["(?, ?)"] * len(part)),
            [v for row in part for v in row],
        )
    return spark.createDataFrame(rows, "script_id string, text string").cache(), db


OPERATORS = {
    "statement_split": blk.split_statements,
    "block_extract": blk.extract_blocks,
    "begin_split": lambda s: blk.split_at_begin(blk.extract_blocks(s)),
    "pack_by_size": lambda s: blk.pack_by_size(blk.extract_blocks(s), 400),
    "merge_small": blk.merge_small,
    "resplit_large": lambda s: blk.resplit_large(s, 400),
    "drop_comment_only": lambda s: blk.drop_comment_only(blk.extract_blocks(s)),
    "chunk_corpus": blk.chunk_corpus,
    "block_stats": lambda s: blk.block_stats(blk.chunk_corpus(s)),
    "block_counts": blk.block_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_random_scripts_against_sql(random_scripts, name):
    scripts, db = random_scripts
    df = OPERATORS[name](scripts)
    got = _sorted_rows(df.columns, df.collect())
    result = db.execute(ORACLE_SQL[name].replace(SCRIPTS_SQL, "SELECT * FROM scripts"))
    assert got == _sorted_rows([c[0] for c in result.description], result.fetchall())


def test_blocks_hold_the_whole_text(random_scripts):
    """Blocks joined equal the input but for blanks, stray ";" and the unterminated tail."""
    scripts, _ = random_scripts
    texts = dict(scripts.collect())
    found = {}
    for r in blk.extract_blocks(scripts).orderBy("block_no").collect():
        found.setdefault(r.script_id, []).append(r.block)

    def bare(text):
        return "".join(text.split()).replace(";", "")

    for script_id, text in texts.items():
        terminated = text[: text.rfind(";") + 1]
        assert bare("".join(found.get(script_id, []))) == bare(terminated)


def test_packed_pieces_respect_the_limit(random_scripts):
    scripts, _ = random_scripts
    for r in blk.pack_by_size(blk.extract_blocks(scripts), 400).collect():
        *before_last, _ = r.piece[:-1].split(";")
        assert sum(len(s.strip("\n")) + 1 for s in before_last) <= 400


def test_tokens(spark):
    text = "a := 'it''s' || \"c d\" <= 1.5 -- n; x\n/* z\n*/ f(b_1) % 'open"
    blocks = spark.createDataFrame([("s", 1, text)], "script_id string, block_no int, block string")
    rows = blk.block_tokens(blocks).orderBy("token_no").collect()
    assert [(r.token_type, r.value) for r in rows] == [
        ("word", "a"), ("operator", ":="), ("string", "'it''s'"), ("operator", "||"),
        ("string", '"c d"'), ("operator", "<="), ("number", "1.5"), ("comment", "-- n; x"),
        ("comment", "/* z\n*/"), ("word", "f"), ("punctuation", "("), ("word", "b_1"),
        ("punctuation", ")"), ("operator", "%"), ("punctuation", "'"), ("word", "open"),
    ]
    assert [r.token_no for r in rows] == list(range(1, 17))


def test_long_string_token_does_not_overflow(column_of):
    text = "'" + "a''" * 200_000 + "'"
    [found] = column_of(tokens.tokens, [text])
    assert found == [text]


def test_tokens_are_found_faster_than_by_trying_every_kind(spark):
    """Words first, letters listed, blanks passed over: the same tokens in less time."""
    plain = "|".join(
        (tokens.COMMENT, tokens.QUOTED, r"[0-9]+(?:\.[0-9]+)?", r"[\p{L}_][\p{L}0-9_$#]*",
         r":=|<=|>=|<>|!=|\|\||=>|\.\.|[-+*/<>=%]", NON_BLANK)
    )
    odd = [" \t\n x\u00a0\u2003y\r\n", "aßb é_1$ é9 _9é 9é1.5.2.", "\U0001d400 \U0001f600;\x85--\x85x", "", " ", "a\t"]
    signs = "ab_9é.'\"-/*:=<>!|; \t\n\xa0"
    odd += ["".join(random.Random(i).choices(signs, k=40)) for i in range(300)]
    long = ["UPDATE accounts SET total = total * 1.1, status = 17 WHERE id = 10;\n" * 20 + str(i) for i in range(4000)]

    def found(texts, pattern):
        df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).cache()
        df.count()
        column = tokens.tokens(F.col("t")) if pattern is None else F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        begin = time.perf_counter()
        rows = df.select(F.xxhash64(column).alias("h"), F.size(column).alias("n")).agg(F.sum("n"), F.bit_xor("h"))
        return tuple(rows.first()), time.perf_counter() - begin

    df = spark.createDataFrame([(t,) for t in odd], "t string")
    pairs = df.select(tokens.tokens(F.col("t")), F.regexp_extract_all("t", F.lit(plain), F.lit(0))).collect()
    assert all(a == b for a, b in pairs)
    times = [(found(long, plain), found(long, None)) for _ in range(3)]
    assert all(a[0] == b[0] for a, b in times)
    assert min(b[1] for _, b in times) < 0.75 * min(a[1] for a, _ in times)


def test_token_types_by_signs(column_of):
    typed = {"--x": "comment", "/*x*/": "comment", "'a'": "string", '""': "string", "'": "punctuation", "é1": "word",
             "·": "punctuation", "||": "operator", "|": "punctuation", "..": "operator", ".": "punctuation",
             ":=": "operator", ":": "punctuation", "!=": "operator", "!": "punctuation", "=>": "operator"}
    assert column_of(tokens.token_type, list(typed)) == list(typed.values())


def test_capitals_of_rare_letters_open_blocks(column_of):
    texts = ["BEG\u0130N x; end;", "beg\u0131n x; End;", "x;CREATE PAC\u212aAGE p; END ;"]
    assert column_of(C.extract_blocks, texts) == [texts[0:1], texts[1:2], ["x;", "CREATE PAC\u212aAGE p; END ;"]]
    assert column_of(C.split_at_begin, ["a BEG\u0130N b beg\u0131n c"]) == [["a", "BEG\u0130N b", "beg\u0131n c"]]


def test_split_with_and_without_comments(column_of):
    texts = ["a;\n b \n;;\u00a0;c", "a; -- x\n; /* y */;c", None, "", "é; \u2003é\u2003 ;"]
    assert column_of(C.split_statements, texts) == [["a", "b", "c"], ["a", "", "", "c"], None, [], ["é", "é"]]


COMPOUND = {
    "routine": (
        "CREATE OR REPLACE PROCEDURE p IS v NUMBER := 0; BEGIN IF a THEN x; END IF; FOR i IN 1..2 LOOP y; END LOOP;"
        " END p; SELECT CASE WHEN a THEN 'b;c' END FROM d; DROP TABLE IF EXISTS t; tail",
        [
            "CREATE OR REPLACE PROCEDURE p IS v NUMBER := 0; BEGIN IF a THEN x; END IF; FOR i IN 1..2 LOOP y;"
            " END LOOP; END p;",
            "SELECT CASE WHEN a THEN 'b;c' END FROM d;",
            "DROP TABLE IF EXISTS t;",
            "tail",
        ],
    ),
    "package": (
        "create package body q as function f return number is begin return 1; end; procedure r is z number;"
        " begin null; end r; end q; commit;",
        [
            "create package body q as function f return number is begin return 1; end; procedure r is z number;"
            " begin null; end r; end q;",
            "commit;",
        ],
    ),
    "anonymous": (
        "DECLARE a NUMBER; BEGIN BEGIN x; END; CASE a WHEN 1 THEN y; END CASE; END; z;",
        ["DECLARE a NUMBER; BEGIN BEGIN x; END; CASE a WHEN 1 THEN y; END CASE; END;", "z;"],
    ),
    "loop over a case": (
        "BEGIN FOR r IN (SELECT CASE WHEN a THEN b END) LOOP x; END LOOP; END; y;",
        ["BEGIN FOR r IN (SELECT CASE WHEN a THEN b END) LOOP x; END LOOP; END;", "y;"],
    ),
    "quoted": (
        "a ';' b; \"c;d\" -- e; f\n; /* g; */ h; 'it''s; BEGIN'; x",
        ["a ';' b;", '"c;d" -- e; f\n;', "/* g; */ h;", "'it''s; BEGIN';", "x"],
    ),
    "end behind a comment": ("BEGIN IF a THEN b; END /* ; */ IF; END; c;", ["BEGIN IF a THEN b; END /* ; */ IF; END;", "c;"]),
    "unclosed quote": ("it's; open; BEGIN x", ["it's;", "open;", "BEGIN x"]),
    "too many ends": ("END; END; BEGIN a; END; b", ["END;", "END;", "BEGIN a; END;", "b"]),
    "names": ("begin_date; x.end$; a_if; b", ["begin_date;", "x.end$;", "a_if;", "b"]),
    "no create": ("DROP FUNCTION f; DROP PACKAGE p; CREATE TABLE t (a NUMBER); b;", ["DROP FUNCTION f;", "DROP PACKAGE p;", "CREATE TABLE t (a NUMBER);", "b;"]),
    "empty ones": (" ;; ; x\r\n;", ["x\n;"]),
    "empty": ("", []),
}


def test_compound_statements(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in COMPOUND.items()], "script_id string, text string")
    got = {k: [] for k in COMPOUND}
    for r in blk.split_compound(rows).orderBy("script_id", "block_no").collect():
        got[r.script_id].append(r.block)
    assert got == {k: v[1] for k, v in COMPOUND.items()}
    null = spark.createDataFrame([("n", None)], "script_id string, text string")
    assert blk.split_compound(null).count() == 0 and blk.chunk_corpus(null, statement_step=True).count() == 0


def test_long_scripts_of_compound_statements(spark):
    one = "DECLARE a NUMBER; BEGIN IF a > 0 THEN b := 'x;y'; END IF; END; c;\n"
    rows = spark.createDataFrame([("s", one * 10_000), ("deep", "BEGIN " * 3000 + "x; " + "END; " * 3000 + "y;")], "script_id string, text string")
    counts = {r.script_id: r["count"] for r in blk.split_compound(rows).groupBy("script_id").count().collect()}
    assert counts == {"s": 20_000, "deep": 2}


def test_statement_step(spark):
    body = "UPDATE t SET a = 1 WHERE b = 'no; end';\n" * 40
    text = f"CREATE PROCEDURE p IS n NUMBER; BEGIN\n{body}END;\nSELECT 1;"
    rows = spark.createDataFrame([("s", text)], "script_id string, text string")
    with_step = [r.block for r in blk.chunk_corpus(rows, statement_step=True).orderBy("block_no").collect()]
    assert "".join("".join(with_step).split()).count("UPDATE") == 40
    small = spark.createDataFrame([("s", "a;\nb; c;")], "script_id string, text string")
    assert blk.chunk_corpus(small, statement_step=True).collect() == blk.chunk_corpus(small).collect()


def test_a_long_statement_is_split_in_time_of_its_length(column_of):
    """Its words were put into upper case anew for every one of them."""
    long = "SELECT " + "word, " * 40_000 + "x FROM t"
    began = time.time()
    [found] = column_of(C.split_compound, [f"BEGIN {long}; END; {long} -- END\n; CASE x"])
    assert time.time() - began < 30
    assert found == [f"BEGIN {long}; END;", f"{long} -- END\n;", "CASE x"]


def test_marks_beside_what_hides_them(column_of):
    cases = {
        "BEGIN a; 1END; b": ["BEGIN a; 1END;", "b"],
        "BEGIN a; END1; b": ["BEGIN a; END1; b"],
        "BEGIN LOOP a; END/* c; */ -- d;\nLOOP; END; b": ["BEGIN LOOP a; END/* c; */ -- d;\nLOOP; END;", "b"],
        "BEGIN IF a; END ıf; END; b": ["BEGIN IF a; END ıf; END;", "b"],
        "BEGıN a; b": ["BEGıN a;", "b"],
        "BEGıN vendor a; b": ["BEGıN vendor a; b"],
        "BEGIN ' END; a": ["BEGIN ' END;", "a"],
        "BEGIN 'it''s END;' x; END; a": ["BEGIN 'it''s END;' x; END;", "a"],
    }
    assert column_of(C.split_compound, list(cases)) == list(cases.values())
