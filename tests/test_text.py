from scriptloom.functions import text as X

TRICKY = [
    "",
    " ",
    "\n",
    "\r\n",
    "a",
    " a b ",
    "\ta\x0bb\x0cc\r",
    "\x1ca\x1db\x1ec\x1fd",
    "\x85a\xa0b c d e f g h　",
    "a\r\nb\rc\n\nd",
    "é😀 ß​x",
    "no break at the end\nlast",
    "ends with break\n",
    "\n\nfirst lines empty",
]


def test_strip_words_and_lines_follow_python(column_of):
    assert column_of(X.strip, TRICKY) == [t.strip() for t in TRICKY]
    assert column_of(X.word_count, TRICKY) == [len(t.split()) for t in TRICKY]
    assert column_of(X.line_count, TRICKY) == [len(t.splitlines()) for t in TRICKY]
    previews = [(t.splitlines() or [""])[0].strip()[:80] for t in TRICKY]
    assert column_of(X.first_line, TRICKY) == previews


def test_every_character_counts_as_python_says(column_of):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b" for c in codes]
    assert column_of(X.word_count, texts) == [len(t.split()) for t in texts]
    assert column_of(X.line_count, texts) == [len(t.splitlines()) for t in texts]
    alone = [chr(c) for c in codes]
    assert column_of(X.strip, alone) == [t.strip() for t in alone]


def test_preview_is_cut_at_80(column_of):
    assert column_of(X.first_line, ["x" * 200 + "\ny"]) == ["x" * 80]


def test_newlines(column_of):
    assert column_of(X.normalize_newlines, ["a\r\nb\rc\n\r\n\r"]) == ["a\nb\nc\n\n\n"]


def test_has_code(column_of):
    cases = {
        "": False,
        " \n\t": False,
        "-- x": False,
        "  -- x\n\n--y": False,
        "-- x\ncode": True,
        "\n\n  code -- x": True,
        "/* c */": True,
        "- x": True,
        "-- a\x0bcode": False,
        "\x0b-- a": False,
    }
    assert column_of(X.has_code, list(cases)) == list(cases.values())


def test_words_are_counted_without_a_last_blank_or_with(column_of):
    texts = ["", " ", "a", " a ", "a\nb\t", "a\x1cb", "\x1c", "é　ü x", "\U0001f600 \U0001f600", "x", "a\\b $1", None]
    assert column_of(X.word_count, texts) == [None if t is None else len(t.split()) for t in texts]
