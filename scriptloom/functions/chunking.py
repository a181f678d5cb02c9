"""Splitting procedural-SQL text into blocks, as expressions over one script per row.

Everything here is narrow: no shuffle, no Python worker. Sizes count characters.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.folds import fold_each
from scriptloom.functions.tokens import COMMENT, QUOTED
from scriptloom.functions.text import (
    BLANK_CLASS,
    BLANKS,
    bind,
    has_code,
    is_blank,
    normalize_newlines,
    starts_plain,
    strip_each,
)

MAX_CHARS = 1200  # a block above this size is cut further
SMALL_CHARS = 180  # blocks below this size are merged with their neighbours
FLUSH_CHARS = 300  # a merged run is closed once it is longer than this

_B = BLANK_CLASS

# What a compound block looks like, in order of preference, and the plain
# statement that is taken otherwise.
_BLOCK_FORMS = (
    rf"CREATE{_B}+(?:OR{_B}+REPLACE{_B}+)?(?:FUNCTION|PROCEDURE|PACKAGE|TRIGGER).*?END{_B}*;",
    rf"DECLARE.*?END{_B}*;",
    rf"BEGIN.*?END{_B}*;",
    r"[^;]+;",
)


def _any_case(pattern: str) -> str:
    """The pattern with every capital as the characters that Java takes for it under ``(?iu)``,
    which it tests several times faster than it folds those of the text."""
    rare = {"I": "\u0130\u0131", "K": "\u212a", "S": "\u017f"}
    return re.sub("[A-Z]", lambda c: f"[{c[0]}{c[0].lower()}{rare.get(c[0], '')}]", pattern)


_BLOCK = "(?s)" + "|".join(map(_any_case, _BLOCK_FORMS))
_UP_TO_LAST_END = _any_case(rf"(?s)^.*END{_B}*;")
_BEFORE_BEGIN = _any_case("(?=BEGIN)")
# A block starting like this is cut at BEGIN even when it is not large.
_COMPOUND_STARTS = ("CREATE", "DECLARE", "BEGIN")
# Words that open, close or announce a compound statement.
_OPENS_INSIDE = ("IF", "LOOP")  # only within one: outside, IF EXISTS and the like are no blocks
_ROUTINES = ("FUNCTION", "PROCEDURE", "TRIGGER")
_MARKS = ("BEGIN", "END", "CASE", "DECLARE", "CREATE", "PACKAGE", *_OPENS_INSIDE, *_ROUTINES)
# A marking word, alone. Upper case of the dotless i and the long s is I and S.
_MARK = "|".join(_MARKS).replace("I", "[I\u0131]").replace("S", "[S\u017f]")
_NO_MORE = r"(?![\p{L}0-9_$#])"
# Up to and with the next marking word, which is group 1, or to the end: words, strings and comments
# are passed over whole. What END closes goes with it. Possessive throughout, as below. Letters
# are listed one by one, which Java tests faster than ranges and much faster than \p{L}.
_LETTERS = string.ascii_letters
_INITIALS = "".join(sorted({c for m in _MARKS for c in m[0] + m[0].lower()})) + "ı"
_TO_MARK = (
    rf"(?:[ \t\n.,;:()=*+<>|!%&?{string.digits}]++"
    rf"|(?!(?=[{_INITIALS}])(?i:{_MARK}){_NO_MORE})(?:[{_LETTERS}_]|\p{{L}})(?:[{_LETTERS}{string.digits}_$#]++|\p{{L}})*+"
    rf"|[^\p{{L}}_'\"/-]|{COMMENT}|{QUOTED}|[-/'\"])*+"
    rf"(?:((?i:{_MARK})){_NO_MORE}"
    rf"(?:(?<=(?i:END))(?:{BLANK_CLASS}|{COMMENT})*+(?i:[Iı]F|LOOP|CA[Sſ]E){_NO_MORE})?+|\z)"
)
# Up to and with a ";" that is in no string, quoted name or comment. What opens one of those
# without closing it is a plain character. Possessive throughout: matched in a loop.
_SEGMENT = rf"(?:[^;'\"/-]++|{QUOTED}|{COMMENT}|[-/'\"])*+;?+"
# Block type by the start of the header line, first match wins.
_BLOCK_TYPES = (
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
_OTHER = "OTHER"


def split_statements(text: Column) -> Column:
    """Split at every ``;``, drop blank pieces, then take comments out of each piece.

    Comments go last: a ``;`` inside a comment or a string splits too, and a piece that was
    only a comment stays as ``''``.
    """

    def commented(part: Column) -> Column:
        return F.contains(part, F.lit("/*")) | F.contains(part, F.lit("--"))

    def without_comments(piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"(?s)/\*.*?\*/", "")
        bare = F.regexp_replace(bare, r"(?d)--.*", "")
        return F.when(commented(piece), bare).otherwise(piece)

    pieces = F.split(text, ";")
    bare = strip_each(F.transform(_nonblank(pieces), without_comments))
    return F.when(commented(text), bare).otherwise(_stripped(pieces))


def split_compound(text: Column) -> Column:
    """Whole statements, compound ones in one piece, stripped; they keep their ``;``, empty ones go.

    A ``;`` ends a statement only outside strings, quoted names and comments, outside BEGIN, CASE,
    IF and LOOP up to their END, outside a package up to its END, and not between DECLARE or the
    head of a created function, procedure or trigger and its BEGIN. The rest of the text is the
    last statement.

    The text is cut at every ``;`` that a lexical scan finds; a fold over these segments carries
    depth and announced BEGIN from one to the next, and closes a statement where neither is left.
    """

    def state(seen: Column, depth: Column, awaits: Column, creates: Column) -> Column:
        fields = {"seen": seen, "depth": depth, "awaits": awaits, "creates": creates}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    def marks(segment: Column) -> Column:
        """The marking words; IF, LOOP and CASE right behind END belong to it."""

        def words(found: Column) -> Column:
            # A rare letter counts as its capital only beside a word, or part of one, in plain letters.
            rare = F.exists(found, lambda t: F.rlike(t, F.lit("[\u0131\u017f]")))
            plain = F.when(rare, F.rlike(segment, F.lit(rf"(?i){'|'.join(_MARKS)}"))).otherwise(True)
            return F.when(plain, F.transform(found, lambda t: F.upper(t))).otherwise(no_words)

        no_words = F.array().cast("array<string>")
        found = F.filter(F.regexp_extract_all(segment, F.lit(_TO_MARK), F.lit(1)), lambda t: t != "")
        return bind(found, words)

    def mark(at: Column, word: Column) -> Column:
        depth, top = at["depth"], (at["depth"] == 0) & ~at["awaits"]
        created = at["creates"] & (depth == 0)
        opens = (
            word.isin("BEGIN", "CASE")
            | (word.isin(*_OPENS_INSIDE) & (depth > 0))
            | ((word == "PACKAGE") & created)
        )
        return state(
            at["seen"],
            F.when(opens, depth + 1).when(word == "END", F.greatest(depth - 1, F.lit(0))).otherwise(depth),
            F.when(word == "BEGIN", False)
            .when((top & (word == "DECLARE")) | (created & word.isin(*_ROUTINES)), True)
            .otherwise(at["awaits"]),
            F.when(word == "CREATE", top).otherwise(at["creates"] & ~word.isin("PACKAGE", *_ROUTINES)),
        )

    def step(at: Column, segment: Column) -> Column:
        def ended(inner: Column) -> Column:
            closes = (inner["depth"] == 0) & ~inner["awaits"]
            now = state(at["seen"] + 1, inner["depth"], inner["awaits"], inner["creates"] & ~closes)
            return F.struct(F.when(closes, F.array(at["seen"] + 1)).otherwise(no_ends).alias("out"), now.alias("state"))

        return bind(F.aggregate(marks(segment), at, mark), ended)

    def statements(segments: Column) -> Column:
        start = state(F.lit(0), F.lit(0), F.lit(False), F.lit(False))
        ends = bind(
            fold_each(segments, start, step, "int"),
            lambda f: F.array_distinct(F.concat(f["out"], F.array(F.size(segments)))),
        )
        return F.filter(_stripped(_join_runs(segments, ends, "")), lambda s: s != ";")

    no_ends = F.array().cast("array<int>")
    found = F.regexp_extract_all(normalize_newlines(text), F.lit(_SEGMENT), F.lit(0))
    return bind(F.filter(found, lambda s: s != ""), statements)


def extract_blocks(text: Column) -> Column:
    """Find compound blocks and plain statements from left to right, stripped.

    A compound block is only found at the start of the text or directly after a ``;``;
    anything else runs to the next ``;``. Text after the last ``;`` is dropped.

    A compound form needs an ``END ;`` ahead, so behind the last one only plain statements
    can follow. Cutting there keeps the cost linear: the pattern never scans to the end of
    a long text in vain, and an unterminated tail is never searched at all.
    """

    def find(code: Column) -> Column:
        return bind(F.regexp_extract(code, _UP_TO_LAST_END, 0), lambda head: blocks(code, head))

    def terminated(pieces: Column) -> Column:
        statements = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda s: s != "")
        return F.transform(statements, lambda s: F.concat(s, F.lit(";")))

    def blocks(code: Column, head: Column) -> Column:
        plain = bind(F.split(F.substr(code, F.length(head) + 1), ";"), terminated)
        found = F.regexp_extract_all(head, F.lit(_BLOCK), F.lit(0))
        return _stripped(F.concat(found, plain))

    return bind(normalize_newlines(text), find)


def split_at_begin(block: Column) -> Column:
    """Cut before every ``BEGIN`` (any case, also inside a word); stripped, no blanks."""
    return _stripped(F.split(block, _BEFORE_BEGIN))


def pack_by_size(block: Column, max_chars: int = MAX_CHARS, stripped: bool = True) -> Column:
    """Cut at ``;`` into runs of statements, closing a run once it exceeds ``max_chars``.

    The limit is soft: a run holds the statement that crossed it, and one long statement is
    never cut. Every statement gets a ``;``, also an unterminated last one.
    """

    def pack(statements: Column) -> Column:
        lengths = F.transform(statements, F.length)
        ends = _run_ends(
            lengths,
            lambda run, length: F.when(run + length > max_chars, F.array(F.lit(_AFTER))),
            lambda run, length: F.when(run + length > max_chars, 0).otherwise(run + length),
        )
        pieces = _join_runs(statements, ends)
        return strip_each(pieces) if stripped else pieces

    statements = F.transform(_nonblank(F.split(block, ";")), lambda s: F.concat(s, F.lit(";")))
    return bind(statements, pack)


def merge_small(
    blocks: Column, small_chars: int = SMALL_CHARS, flush_chars: int = FLUSH_CHARS
) -> Column:
    """Join runs of small neighbours by a newline until a run is over ``flush_chars``.

    A block that is not small closes the run before it and stands alone.
    """

    def counted(block: Column) -> Column:
        # A character has at most four bytes: of what cannot be small the length makes no difference.
        return F.when(F.octet_length(block) < 4 * small_chars, F.length(block)).otherwise(small_chars)

    def merge(kept: Column) -> Column:
        lengths = F.transform(kept, counted)
        alone, after = F.array(F.lit(_BEFORE), F.lit(_AFTER)), F.array(F.lit(_AFTER))
        ends = _run_ends(
            lengths,
            lambda run, length: F.when(
                length < small_chars, F.when(run + length > flush_chars, after)
            ).otherwise(F.when(run > 0, alone).otherwise(after)),
            lambda run, length: F.when(
                (length < small_chars) & (run + length <= flush_chars), run + length
            ).otherwise(0),
        )
        return _join_runs(kept, ends)

    return bind(_nonblank(blocks), merge)


def resplit_large(blocks: Column, max_chars: int = MAX_CHARS) -> Column:
    """Pack every block above ``max_chars`` again, without stripping the pieces."""
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.when(
                _longer(b, max_chars), pack_by_size(b, max_chars, stripped=False)
            ).otherwise(F.array(b)),
        )
    )


def drop_comment_only(blocks: Column) -> Column:
    return F.filter(blocks, has_code)


def chunk(
    text: Column,
    max_chars: int = MAX_CHARS,
    small_chars: int = SMALL_CHARS,
    flush_chars: int = FLUSH_CHARS,
) -> Column:
    """The whole chunker: blocks, cut where large, small ones merged, large ones re-cut.

    One block from :func:`extract_blocks` counts as one statement. Taken apart into statements
    first (see :func:`compound_statements`), its pieces are mostly small and would be merged
    again, so that only blanks and merge borders can differ.
    """

    def cut(block: Column) -> Column:
        pieces = _cut_statement(block, max_chars)
        return F.when(_is_compound(block, max_chars), pieces).otherwise(F.array(block))

    fine = F.flatten(F.transform(extract_blocks(text), cut))
    return merge_and_resplit(fine, max_chars, small_chars, flush_chars)


def compound_statements(blocks: Column, max_chars: int = MAX_CHARS) -> Column:
    """``STRUCT<block, statements>`` for every block: the statements of one that is large or starts
    a compound statement, NULL for others."""
    return F.transform(
        blocks,
        lambda b: F.struct(
            b.alias("block"), F.when(_is_compound(b, max_chars), split_compound(b)).alias("statements")
        ),
    )


def cut_statements(parts: Column, max_chars: int = MAX_CHARS) -> Column:
    """The blocks of :func:`compound_statements`, every statement cut by its own size."""

    def cut(part: Column) -> Column:
        pieces = F.flatten(F.transform(part["statements"], lambda s: _cut_statement(s, max_chars)))
        return F.coalesce(pieces, F.array(part["block"]))

    return F.flatten(F.transform(parts, cut))


def merge_and_resplit(
    fine: Column,
    max_chars: int = MAX_CHARS,
    small_chars: int = SMALL_CHARS,
    flush_chars: int = FLUSH_CHARS,
) -> Column:
    """The end of the chunker: small neighbours merged, large blocks packed again."""
    merged = merge_small(fine, small_chars, flush_chars)
    return drop_comment_only(resplit_large(merged, max_chars))


def _is_compound(block: Column, max_chars: int) -> Column:
    return _longer(block, max_chars) | _starts_with_any(block, _COMPOUND_STARTS)


def _cut_statement(statement: Column, max_chars: int) -> Column:
    pieces = F.flatten(
        F.transform(
            split_at_begin(statement),
            lambda p: F.when(_longer(p, max_chars), pack_by_size(p, max_chars)).otherwise(
                F.array(p)
            ),
        )
    )
    return F.when(_longer(statement, max_chars), drop_comment_only(pieces)).otherwise(
        drop_comment_only(F.array(statement))
    )


def block_type(block: Column) -> Column:
    # No prefix ends with a blank, so blanks behind a short text make no difference.
    longest = max(len(prefix) for prefix, _ in _BLOCK_TYPES)
    bare = F.when(starts_plain(block), block).otherwise(F.ltrim(block, F.lit(BLANKS)))
    header = F.upper(F.substring(bare, 1, longest))
    (prefix, kind), *others = _BLOCK_TYPES
    types = F.when(F.startswith(header, F.lit(prefix)), kind)
    for prefix, kind in others:
        types = types.when(F.startswith(header, F.lit(prefix)), kind)
    return types.otherwise(_OTHER)


def _longer(text: Column, max_chars: int) -> Column:
    """More characters than ``max_chars``; they are only counted where there are as many bytes."""
    return (F.octet_length(text) > max_chars) & (F.length(text) > max_chars)


def _nonblank(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: ~is_blank(p))


def _stripped(pieces: Column) -> Column:
    """The pieces stripped, those left empty dropped."""
    return F.filter(strip_each(pieces), lambda p: p != "")


def _starts_with_any(block: Column, prefixes: tuple[str, ...]) -> Column:
    # No other letters have these capitals. Few blocks get past them.
    initial = F.substring(block, 1, 1).isin(*sorted({c for p in prefixes for c in p[0] + p[0].lower()}))
    start = F.upper(F.substring(block, 1, max(map(len, prefixes))))
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.startswith(start, F.lit(prefix))
    return initial & found


# Where a run ends, relative to the element being looked at.
_BEFORE, _AFTER = 0, 1


def _run_ends(lengths: Column, closes, next_run) -> Column:
    """Positions (1-based, inclusive) at which runs of elements end.

    ``closes(run, length)`` gives the offsets at which runs end when the element is added
    to a run of total length ``run`` (NULL: none), ``next_run`` the length of the run that
    stays open. The rest forms the last run. The reset makes this a fold; a window over
    exploded rows cannot express it.
    """
    no_ends = F.array().cast("array<int>")

    def state(seen: Column, run: Column) -> Column:
        return F.struct(seen.alias("seen"), run.cast("int").alias("run"))

    def step(acc: Column, length: Column) -> tuple[Column, Column]:
        found = F.transform(closes(acc["run"], length), lambda offset: acc["seen"] + offset)
        return found, state(acc["seen"] + 1, next_run(acc["run"], length))

    def finish(folded: Column) -> Column:
        last = folded["state"]
        rest = F.when(last["run"] > 0, F.array(last["seen"])).otherwise(no_ends)
        return F.concat(folded["out"], rest)

    return bind(fold_each(lengths, state(F.lit(0), F.lit(0)), step, "int"), finish)


def _join_runs(elements: Column, ends: Column, separator: str = "\n") -> Column:
    """One string per run, its elements joined by a newline or ``separator``."""

    def join(all_ends: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            before = F.coalesce(F.get(all_ends, i - 1), F.lit(0))
            return F.array_join(F.slice(elements, before + 1, end - before), separator)

        return F.transform(all_ends, one)

    return bind(ends, join)
