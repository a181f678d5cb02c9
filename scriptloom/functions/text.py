"""Python-like text rules as built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_USUAL_BLANKS = "\n \t\r"
# The same as character classes. Only use them un-negated: Java tests a negated class with
# characters beyond Latin-1 more than ten times slower.
_RARE_BLANKS = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_CLASS = rf"[\t-\r\x20{_RARE_BLANKS}]"
NON_BLANK = rf"(?!{BLANK_CLASS})[\s\S]"
_INDENT_CLASS = rf"[\t\x0b-\r\x20{_RARE_BLANKS}]"
# The characters Python's str.splitlines() breaks at (besides "\r\n").
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_RARE_BREAKS = r"[\x0b-\r\x1c-\x1e\x85\u2028\u2029]"
_BREAK_CLASS = r"[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Used where ``body`` needs the value inside a lambda: as a plain column the optimizer
    may inline it there and recompute it for every array element.
    """
    return F.transform(F.array(value), body).getItem(0)


def normalize_newlines(text: Column) -> Column:
    replaced = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\r")), replaced).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def starts_plain(text: Column) -> Column:
    """The first character is visible ASCII; false for an empty text."""
    return (text >= "!") & (text < "\x7f")


def _ends_plain(text: Column) -> Column:
    """The last character is visible ASCII, told by the last byte: :func:`F.right` counts all
    characters first."""
    last = F.substring(text.cast("binary"), -1, 1)
    return (last >= F.lit(b"!")) & (last < F.lit(b"\x7f"))


def _left_stripped(text: Column) -> Column:
    """Without the usual blanks at the start. Spark's trim looks every character up in the whole
    set, so this short one goes first; others are left to :func:`strip`."""
    return F.when(starts_plain(text), text).otherwise(F.ltrim(text, F.lit(_USUAL_BLANKS)))


def strip_each(texts: Column) -> Column:
    """:func:`strip` of every element. Spark's trim with a character set indexes the whole text,
    so it is only called where an end is blank."""

    def one(text: Column) -> Column:
        blank = F.lit(BLANKS)
        open_start = F.contains(blank, F.left(text, F.lit(1)))
        open_end = F.contains(blank, F.right(text, F.lit(1)))
        plain = starts_plain(text) & _ends_plain(text)
        return F.when(plain, text).when(open_start | open_end, strip(text)).otherwise(text)

    return F.transform(F.transform(texts, _left_stripped), one)


def is_blank(text: Column) -> Column:
    return ~starts_plain(_left_stripped(text)) & (F.ltrim(text, F.lit(BLANKS)) == "")


def word_count(text: Column) -> Column:
    """Number of words as Python's ``len(text.split())`` counts them."""

    def words(of: Column) -> Column:
        # Each word and the blanks around it as one character, up to a last one that is added:
        # no array of words is made, as counting matches would.
        return F.length(F.regexp_replace(F.concat(of, F.lit(" x")), r"\s*+\S++\s*+", "x")) - 1

    rare_ascii = F.lit(False)
    for char in "\x1c\x1d\x1e\x1f":
        rare_ascii = rare_ascii | F.contains(text, F.lit(char))
    ascii_only = F.octet_length(text) == F.length(text)
    has_rare = rare_ascii | (~ascii_only & F.rlike(text, F.lit(f"[{_RARE_BLANKS}]")))
    split_at_all = F.regexp_replace(text, f"[{_RARE_BLANKS}]", " ")
    return F.when(has_rare, words(split_at_all)).otherwise(words(text))


def line_count(text: Column) -> Column:
    """Number of lines; a line break at the very end does not start another line."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    breaks = F.when(
        F.rlike(text, F.lit(_RARE_BREAKS)),
        F.regexp_count(text, F.lit(rf"\r\n|{_BREAK_CLASS}")),
    ).otherwise(newlines)
    ends_open = (text != "") & ~F.contains(F.lit(LINE_BREAKS), F.right(text, F.lit(1)))
    return breaks + ends_open.cast("int")


def first_line(text: Column, max_chars: int = 80) -> Column:
    line = F.split(F.substring_index(text, "\n", 1), _RARE_BREAKS, 2).getItem(0)
    return F.substring(strip(line), 1, max_chars)


def has_code(text: Column) -> Column:
    """False if every line is blank or a ``--`` comment.

    Looks for a line that, behind its indent, neither ends nor starts a comment. (?d): only
    ``\\n`` ends a line; the possessive ``*+`` keeps the search linear. Most texts have code in their
    first column.
    """
    at_once = starts_plain(text) & ~F.startswith(text, F.lit("--"))
    return at_once | F.rlike(text, F.lit(rf"(?md)^{_INDENT_CLASS}*+(?!--|\n|\z)"))
