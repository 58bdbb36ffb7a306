"""Code units: lexical splitting of files and per-unit features.

A unit table has at least ``path, name, kind, start_line, end_line, ordinal, prefix, code``.
Callers that have a real parser bring such a table; `split_files` derives one from source
text without a syntax tree, so its units, identifiers, depth and complexity are lexical
approximations.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions import text as tx
from inkprint.functions.rows import bind, explode_once
from inkprint.functions.scalars import digest

MIN_LOC = 3
CHUNK = 256
NEAR_LINES = 80

# Declaration heads, matched on masked text; each ends at the brace that opens its body.
# White space is plain in it, and classes name their characters: each look at one is a single step then, as
# ranges and parts of classes are not.
_WS, _RARE = fixed.WS_PLAIN, "".join(c for c in fixed.WS_CHARACTERS if c > "\u00ff")
_WS_INLINE = _WS.replace(r"\n", "")
_S = rf"[{_WS}]*+"
_LETTERS, _DIGITS = string.ascii_letters, string.digits
_NAME = rf"[{_LETTERS}_$#][{_LETTERS}{_DIGITS}_$]*+"
_ARGS = r"\((?:[^()]++|\([^()]*+\))*+\)"
_TYPE_ARGS = r"(?:<[^<>{}()]*+>)?"
_RETURN_TYPE = rf"(?:{_S}:[^{{}};=]++)?"
_NOT_A_METHOD = r"(?!(?:if|for|while|switch|catch|with|function|return|constructor|super|new|await|typeof|do|else|try)(?![\w$]))"
_BINDING = rf"(?:(?:const|let|var)\s+{_NAME}{_S}(?::(?:{_S}{_ARGS}{_S}=>)?[^=;{{}}()]++)?=(?!>){_S}|{_NAME}{_S}:{_S})?"
_TO_BODY = rf"{_BINDING}(?:async\s+)?(?:{_ARGS}(?:{_S}:[^=>{{}};()]++)?|{_NAME}){_S}=>"
_ARROW = rf"{_TO_BODY}{_S}\{{"
# The same with an expression as its body; the head ends at the arrow.
_EXPRESSION = rf"{_TO_BODY}(?!{_S}\{{)"
_SIGN = "[=(,:?&|!+]"
_VALUE = rf"(?:async\s+)?(?:function(?![\w$])[^(){{}}]*+{_ARGS}{_RETURN_TYPE}|class(?![\w$])[^{{}};]*+){_S}\{{"
_PLAIN = (
    rf"(?:{_SIGN}|return(?![\w$])){_S}{_VALUE}"
    rf"|(?:static\s+)?(?:get|set)\s+{_NAME}{_S}{_ARGS}{_RETURN_TYPE}{_S}\{{"
)
_MODIFIED = r"(?:export\s+)?(?:default\s+)?"
_FUNCTION = (
    rf"{_MODIFIED}(?:async\s+)?function(?![\w$]){_S}\*?{_S}(?:{_NAME})?{_S}"
    rf"{_TYPE_ARGS}{_S}{_ARGS}{_RETURN_TYPE}{_S}\{{"
)
_CLASS = rf"{_MODIFIED}(?:abstract\s+)?class(?![\w$])[^{{}};]*+\{{"
_METHOD = (
    rf"(?:(?:public|private|protected|static|readonly|override|async)\s+)*{_NOT_A_METHOD}{_NAME}"
    rf"{_TYPE_ARGS}{_S}{_ARGS}{_RETURN_TYPE}{_S}\{{"
)
# What any head begins with: a sign, one of these words, or a name before a bracket, a colon or an arrow.
# Most words are none of that, which one look tells; the heads are searched only behind it.
_LIKE_A_HEAD = (
    r"(?=[=(,:?&|!+]|(?:export|default|async|function|abstract|class|return|static|get|set|const|let|var|public|private|protected"
    rf"|readonly|override)(?![\w$])|{_NAME}{_S}[(<:=])"
)
_HEADS = f"{_LIKE_A_HEAD}(?:{_FUNCTION}|{_CLASS}|{_PLAIN}|{_ARROW}|{_METHOD})"
# Heads, single braces, and stretches of anything between them.
_WORD, _MAY_OPEN = f"[{_LETTERS}{_DIGITS}_$#]", "=(,:?&|!+"
_PARTS = (
    rf"(?:{_HEADS}|[{{}}]|(?:(?!{_HEADS})(?:{_WORD}++|[{_MAY_OPEN}])|[^{_LETTERS}{_DIGITS}_$#{{}}{_MAY_OPEN}]++)++)"
)

# For files with expressions as bodies all brackets count, and what may end a statement: commas,
# semicolons, and line breaks between what ends an operand and what cannot go on with it.
_HEADS_AND_EXPRESSIONS = f"{_LIKE_A_HEAD}(?:{_FUNCTION}|{_CLASS}|{_PLAIN}|{_ARROW}|{_EXPRESSION}|{_METHOD})"
# Where only the presence of a head counts, what follows the arrow does not; what it begins with tells what it may be.
_ARGS_TO_BODY = rf"{_ARGS}(?:{_S}:[^=>{{}};()]++)?{_S}=>"
_SIGN_HEAD = rf"{_SIGN}{_S}(?=[acf]){_VALUE}"
_BRACKET_HEAD = rf"\({_S}(?=[acf]){_VALUE}|{_ARGS_TO_BODY}"
_HEAD_WORD = (
    r"(?:a(?:sync|bstract)|c(?:lass|onst)|default|export|function|get|let|override|p(?:ublic|rivate|rotected)"
    r"|r(?:eturn|eadonly)|s(?:tatic|et)|var)(?![\w$])"
)
_WORD_HEAD = (
    rf"(?:(?={_NAME}{_S}[(<:=])(?!{_HEAD_WORD})(?:{_NAME}{_S}(?:=>|:{_S}(?:async\s+)?(?:{_ARGS_TO_BODY}|{_NAME}{_S}=>))"
    rf"|{_NOT_A_METHOD}{_NAME}{_TYPE_ARGS}{_S}{_ARGS}{_RETURN_TYPE}{_S}\{{)"
    rf"|(?={_HEAD_WORD})(?:{_FUNCTION}|{_CLASS}|{_PLAIN}|{_TO_BODY}|{_METHOD}))"
)
_BREAK = (
    rf"(?<=[{_LETTERS}{_DIGITS}_$)\]}}\"])[{_WS_INLINE}]*+\n{_S}(?=[{_LETTERS}_$\"{{@#!~])"
    r"(?!(?:in|instanceof|as|satisfies)(?![\w$]))"
)
# A line break behind a closing bracket ends a statement before the other heads and at the end of the text too.
_GAP = (
    rf"(?<=[)\]}}])(?=[{_WS_INLINE}]*\n)[{_WS}]++"
    rf"(?:\z|(?={_SIGN})(?={_BRACKET_HEAD}|{_SIGN_HEAD})|(?=(?:in|instanceof|as|satisfies)(?![\w$]))(?={_WORD_HEAD}))"
)
_SOLID = rf"[^{_LETTERS}{_DIGITS}_$#{{}}()\[\],;=:?&|!+{_WS}]++"
# An arrow of what is no head, right before a part, stands for an expression that begins where the text before it does.
_STRAY = rf"=>(?=[()\[\]{{}},;]|{_SIGN_HEAD}|{_WORD_HEAD})"
_NO_HEAD = rf"{_SOLID}|(?={_WORD})(?:(?!{_HEAD_WORD}){_WORD}++(?!{_S}[(<:=])|(?!{_WORD_HEAD}){_WORD}++)|(?=[=:?&|!+])(?!{_SIGN_HEAD}|{_STRAY})[=:?&|!+]"


def _closed(opening: str, closing: str, others: str = "", words: str = "", inside: str = "") -> str:
    """A pair of brackets and what is in it if no head can begin there: without these words and signs."""
    return (
        rf"\{opening}(?:[^{_LETTERS}{_DIGITS}_$#=(){{}}\[\]{others}]++|(?!(?:class|function{words})(?![\w$])){_WORD}++|=(?!>)"
        rf"{inside})*+\{closing}"
    )


# Brackets without a head in them change no stack and are read over, up to two of them in each other. Types
# in square brackets may go on behind them; what may be arguments of a head within others is no such pair.
_SQUARE = ("[", "]", "<", "|const|let|var")
_FLAT = "|" + "|".join((_closed("(", ")") + rf"(?!{_S}(?:[:{{]|=>))", _closed(*_SQUARE), _closed("{", "}")))
_QUIET = "|".join((
    _closed("(", ")", inside=_FLAT) + rf"(?!(?:{_S}:[^=>{{}};()]++)?{_S}=>)", _closed(*_SQUARE, inside=_FLAT), _closed("{", "}", inside=_FLAT)
))
# What ends statements means nothing where no expression can be on top: behind what opens a brace or bracket, or another end.
_ON = rf"(?<!>)(?:[;{_WS}]++|{_NO_HEAD}|(?=,)(?!{_SIGN_HEAD}),|{_QUIET})*+"
_BRACKET_PARTS = (
    rf"((?:[{_WS_INLINE}]++(?!\n)|{_NO_HEAD}|{_QUIET}|(?=[{_WS}])(?!{_BREAK}|{_GAP})[{_WS}]++)*+)(?:([)\]}}])|"
    rf"(?:{_LIKE_A_HEAD}(?:({_PLAIN})|({_FUNCTION}|{_CLASS}|{_ARROW}|{_EXPRESSION}|{_METHOD}|{_STRAY}))|([(\[{{,;]|{_BREAK}|{_GAP}))({_ON})?+|(?!\G)\z)"
)
# Three texts a part: the head of a unit, the head of a block, and all of the part up to the next one.
_MARK = "\x01"
_MARKED = f"$1{_MARK}$4{_MARK}$3{_MARK}$2$3$4$5$6"
_HAS_EXPRESSION = rf"=>(?![{fixed.WS}]*+\{{)"

_FRAME = "struct<kind:string,name:string,line:int,col:int>"
_SPAN = "struct<line:int,col:int,end_line:int,end_col:int,kind:string,name:string>"
_PLACE = "struct<part:int,line:int,col:int>"
_PLACES = "struct<part:int,line:int,col:int,end_line:int,end_col:int>"


def _if(condition: Column, then: Column, other: Column) -> Column:
    """For steps of folds, where it takes a fraction of the time of `when`."""
    return F.call_function("if", condition, then, other)


def _newlines(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))


def _column_after(part: Column, col: Column) -> Column:
    """Characters on the current line once ``part`` has been read."""
    return F.when(F.instr(part, "\n") > 0, F.length(F.substring_index(part, "\n", -1))).otherwise(col + F.length(part))


def _frame(part: Column, line: Column, col: Column) -> Column:
    """What the brace at the end of ``part`` opens."""
    block = (part == "{") | part.rlike(f"^(?:{_PLAIN})$")
    kind = _if(block, F.lit("block"), _unit_kind(part))
    return _named_frame(part, kind, line, col)


def _unit_kind(head: Column) -> Column:
    word = lambda w: head.rlike(rf"^{_MODIFIED}(?:async\s+|abstract\s+)?{w}(?![\w$])")
    return _if(
        word("function"), F.lit("function"),
        _if(word("class"), F.lit("class"), _if(head.rlike(r"=>\s*\{$"), F.lit("arrow"), F.lit("method"))),
    )


def _named_frame(part: Column, kind: Column, line: Column, col: Column) -> Column:
    arrow = lambda k: k == "arrow"

    def frame(k: Column, lead: Column) -> Column:
        declared = _if(
            arrow(k), _if(lead == "", F.lit(""), F.regexp_extract(lead, rf"^(?:(?:const|let|var)\s+)?({_NAME})", 1)),
            _if(
                k == "function", F.regexp_extract(part, rf"function{_S}\*?{_S}({_NAME})", 1),
                _if(
                    k == "class", F.regexp_extract(part, rf"class\s+(?!(?:extends|implements)(?![\w$]))({_NAME})", 1),
                    F.regexp_extract(part, rf"({_NAME}){_TYPE_ARGS}{_S}\(", 1),
                ),
            ),
        )
        name = F.coalesce(F.nullif(declared, F.lit("")), F.lit("<anonymous>"))
        return F.struct(
            k.alias("kind"),
            name.alias("name"),
            (line + _newlines(lead)).cast("int").alias("line"),
            _column_after(lead, col).cast("int").alias("col"),
        ).cast(_FRAME)

    lead = lambda k: _if(arrow(k), F.regexp_extract(part, f"^({_BINDING})", 1), F.lit(""))
    return bind(kind, lambda k: bind(lead(k), lambda found: frame(k, found)))


def _stray_frame(parts: Column, s: Column) -> Column:
    """The frame of an arrow that belongs to no head; its place is that of the part before it."""
    i = s["part"]
    before = F.get(parts, 3 * i)
    head = _if(i == 0, F.lit(""), F.concat(F.get(parts, 3 * i - 2), F.get(parts, 3 * i - 1)))
    ended = _if((i > 0) & before.rlike(rf"^[{_WS}]"), F.ltrim(before, F.lit("\t\n\x0b\f\r \u00a0")), before)
    rest = F.regexp_extract(ended, rf"(?s)^(?:.*(?:[()\[\]{{}},;]|{_BREAK}))?(.*)$", 1)
    # a head may have any signs in it
    text = _if(F.length(rest) > F.length(before) - F.length(head), F.substr(before, F.length(head) + 1), rest)

    def frame(text: Column) -> Column:
        ahead = F.left(before, F.length(before) - F.length(text))
        return _named_frame(F.concat(text, F.lit("=>")), F.lit("arrow"), s["line"] + _newlines(ahead), _column_after(ahead, s["col"]))

    return bind(text, frame)


def has_expressions(source: Column) -> Column:
    """Whether an arrow's body may be an expression, in which case all brackets of the file count."""
    return source.rlike(_HAS_EXPRESSION)


def _plain_space(text: Column) -> Column:
    """The text with one white space for the rare ones, as long as before."""
    plain = lambda t: F.translate(t, _RARE, "\u00a0" * len(_RARE))
    return bind(text, lambda t: _if(F.length(t) == F.octet_length(t), t, plain(t)))


def source_parts(source: Column, brackets: Column | None = None) -> Column:
    """The masked text cut into heads, braces and what lies between.

    Where ``brackets`` holds: what stands before the first part, and three texts for every head,
    bracket and statement's end that may matter, as `_MARKED` has them.
    """
    plain = F.regexp_extract_all(_plain_space(tx.masked(source)), F.lit(_PARTS), F.lit(0))
    if brackets is None:
        return plain
    # no pattern tells the mark from another control character
    text = F.replace(_plain_space(tx.masked(source, '"')), F.lit(_MARK), F.lit("\x02"))
    return F.when(brackets, F.split(F.regexp_replace(text, _BRACKET_PARTS, _MARKED), _MARK)).otherwise(plain)


# Codes of parts are places in this text: heads of expressions, stray arrows, heads of units and blocks, single
# signs, and heads of blocks that bring the bracket or the comma before them along. 0 is a statement's end.
_CODES = "EsUB{([)]}pc"
_CODE = {letter: i + 1 for i, letter in enumerate(_CODES)}


def _part_facts(parts: Column):
    """All that a step of the fold has to know of a part, whatever came before it; patterns are searched outside."""

    def facts(i: Column) -> Column:
        head, block, part = (F.get(parts, 3 * i + k) for k in (1, 2, 3))
        letter = _if(
            head != "", _if(head.endswith(">"), _if(head == "=>", F.lit("s"), F.lit("E")), F.lit("U")),
            _if(block == "", F.left(part, F.lit(1)), _if(block.startswith("("), F.lit("p"), _if(block.startswith(","), F.lit("c"), F.lit("B")))),
        )
        return F.struct(
            i.alias("part"), F.instr(F.lit(_CODES), letter).alias("code"),
            _newlines(part).alias("lines"), F.length(F.substring_index(part, "\n", -1)).alias("rest"),
        )

    return facts


def _part_step(state, parts: Column):
    """One step of the fold where all brackets count; frames are braces, brackets and expressions as bodies.

    The stack is a text of one letter a frame: ``E`` for an expression, ``P`` for a bracket, ``U`` for
    the brace of a unit and ``B`` for that of a block; ``places`` has where the units among them began.
    An expression ends at the last character before what closes it: a comma, a statement's end, or the
    bracket around it. A bracket that was never opened closes nothing, one that was never closed goes with
    the brace around it. Steps that end no unit, which most are, do little more than count on.
    """

    def step(s: Column, part: Column) -> Column:
        code, open_ = part["code"], s["open"]
        line = s["line"] + part["lines"]
        col = _if(part["lines"] > 0, part["rest"], s["col"] + part["rest"])
        brace, end = code == _CODE["}"], (code == 0) | (code == _CODE["c"])
        last = lambda letter: open_.endswith(letter)

        def move(opened: Column, places: Column = s["places"], done: Column = s["done"]) -> Column:
            return state(line, col, s["line"], s["col"], opened, places, done)

        def end_of_expression() -> Column:
            # an expression is on top only behind its head or a closing bracket: the part before is not blank
            before = F.regexp_replace(F.get(parts, 3 * part["part"]), rf"[{_WS}]+$", "")
            return bind(before, lambda solid: F.struct(
                (s["before_line"] + _newlines(solid)).alias("line"), _column_after(solid, s["before_col"]).alias("col"),
            ))

        def units(places: Column, line: Column, col: Column) -> Column:
            return F.transform(places, lambda p: F.struct(
                p["part"].alias("part"), p["line"].alias("line"), p["col"].alias("col"), line.alias("end_line"), col.alias("end_col"),
            ))

        def close(left: Column) -> Column:
            n = F.length(left)
            expressions = F.length(F.replace(F.substr(open_, n + 1), F.lit("P"), F.lit("")))
            opened = (
                _if(code == _CODE["c"], F.concat(left, F.lit("B")), _if(_if(brace, n > 0, ~end & left.endswith("P")), F.left(left, n - 1), left))
            )

            def closed(kept: Column) -> Column:
                ended = _if(
                    kept < F.size(s["places"]),
                    bind(end_of_expression(), lambda at: F.concat(
                        s["done"], units(F.slice(s["places"], kept + 1, F.size(s["places"])), at["line"], at["col"])
                    )),
                    s["done"],
                )
                whole = units(F.slice(s["places"], kept, F.lit(1)), s["line"], s["col"] + 1)
                unit = brace & left.endswith("U")
                places = F.slice(s["places"], F.lit(1), kept - unit.cast("int"))
                return move(opened, places, _if(unit, F.concat(ended, whole), ended))

            return bind(F.size(s["places"]) - expressions, closed)

        closes = (code == 0) | (code >= _CODE[")"]) & (code != _CODE["p"])
        # of what closes nothing but a bracket or a block, only the letter goes
        only = _if(brace, last("B"), last("P") & ~end)
        plain = only | (open_ == "") & (code != _CODE["c"]) | (code == 0) & ~last("E")
        stray = code == _CODE["s"]
        place = F.struct(
            part["part"].alias("part"), _if(stray, s["before_line"], s["line"]).alias("line"), _if(stray, s["before_col"], s["col"]).alias("col"),
        )
        return _if(
            closes,
            _if(
                plain, move(_if(only, F.left(open_, F.length(open_) - 1), open_)),
                bind(F.rtrim(open_, _if(brace, F.lit("EP"), F.lit("E"))), close),
            ),
            _if(
                code <= _CODE["U"], move(F.concat(open_, _if(code == _CODE["U"], F.lit("U"), F.lit("E"))), F.concat(s["places"], F.array(place))),
                move(F.concat(open_, _if(code <= _CODE["{"], F.lit("B"), _if(code == _CODE["p"], F.lit("PB"), F.lit("P"))))),
            ),
        )

    return step


def unit_spans(parts: Column, brackets: Column | None = None) -> Column:
    """Array of the unit spans of one file that have enough lines for a unit (lines from 1, columns from 0).

    ``ordinal`` is a span's place among all spans of the file, in order of their start. ``brackets`` says
    whether the parts hold all brackets. ``parts`` should be a column of its own.
    """

    def long(spans: Column, facts) -> Column:
        """Only spans that may be units are looked at closely."""
        numbered = F.transform(spans, lambda s, i: F.struct(i.alias("ordinal"), s.alias("span")))
        kept = F.filter(numbered, lambda n: n["span"]["end_line"] - n["span"]["line"] >= MIN_LOC - 1)
        return F.transform(kept, lambda n: facts(n["ordinal"], n["span"], n["span"]))

    def span(ordinal: Column, frame: Column, s: Column) -> Column:
        return F.struct(
            ordinal.alias("ordinal"), frame["line"].alias("line"), frame["col"].alias("col"),
            s["end_line"].alias("end_line"), s["end_col"].alias("end_col"), frame["kind"].alias("kind"), frame["name"].alias("name"),
        )

    def named(ordinal: Column, s: Column, _: Column) -> Column:
        kind = lambda head: _if(head.endswith(">"), F.lit("arrow"), _unit_kind(head))
        named_head = lambda head: _named_frame(head, kind(head), s["line"], s["col"])
        frame = bind(F.get(parts, 3 * s["part"] + 1), lambda head: _if(head == "=>", _stray_frame(parts, s), named_head(head)))
        return bind(frame, lambda f: span(ordinal, f, s))

    plain = long(_spans(parts, False), span)
    return plain if brackets is None else F.when(brackets, long(_spans(parts, True), named)).otherwise(plain)


def _spans(parts: Column, brackets: bool) -> Column:
    """A fold over ``parts`` with a stack of what is open.

    Growing an array inside a fold copies it each time, so the fold runs in chunks: each chunk
    collects its own spans and hands on line, column and stack. With ``brackets`` a span has the number of
    the part it begins with, and begins where that part does.
    """
    if brackets:
        return bind(parts, _spans_of_marked)
    last_chunk = F.floor((F.size(parts) - 1) / CHUNK).cast("int")
    chunks = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(0), last_chunk)),
        lambda i: F.slice(parts, i * CHUNK + 1, F.lit(CHUNK)),
    )

    def state(line: Column, col: Column, opened: Column, done: Column) -> Column:
        return F.struct(line.alias("line"), col.alias("col"), opened.alias("open"), done.alias("done"))

    no_spans = F.array().cast(f"array<{_SPAN}>")
    start = state(F.lit(1), F.lit(0), F.array().cast(f"array<{_FRAME}>"), F.array().cast(f"array<array<{_SPAN}>>"))

    def step(s: Column, part: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))
        closes = part == "}"
        unit = F.struct(
            top["line"].alias("line"), top["col"].alias("col"),
            s["line"].alias("end_line"), (s["col"] + 1).alias("end_col"),
            top["kind"].alias("kind"), top["name"].alias("name"),
        ).cast(_SPAN)
        opened = (
            F.when(part.endswith("{"), F.concat(s["open"], F.array(_frame(part, s["line"], s["col"]))))
            .when(closes & (F.size(s["open"]) > 0), F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1))
            .otherwise(s["open"])
        )
        done = F.when(
            closes & F.coalesce(top["kind"] != "block", F.lit(False)), F.concat(s["done"], F.array(unit))
        ).otherwise(s["done"])
        return state(s["line"] + _newlines(part), _column_after(part, s["col"]), opened, done)

    def run_chunk(before: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            state(before["line"], before["col"], before["open"], no_spans),
            step,
            lambda s: state(s["line"], s["col"], s["open"], F.concat(before["done"], F.array(s["done"]))),
        )

    return F.aggregate(chunks, start, run_chunk, lambda s: F.sort_array(F.flatten(s["done"])))


def _spans_of_marked(parts: Column) -> Column:
    # what is left behind the last part is marked like a part, an empty one
    size = F.floor(F.size(parts) / 3).cast("int") - (F.element_at(parts, -1) == "").cast("int")
    chunks = F.transform(
        F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))),
        lambda i: F.sequence(i * CHUNK, F.least(i * CHUNK + CHUNK, size) - 1),
    )
    names = ("line", "col", "before_line", "before_col", "open", "places", "done")
    state = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, names)))
    first = F.get(parts, 0)
    none = lambda items: F.array().cast(f"array<{items}>")
    start = state(
        F.lit(1) + _newlines(first), F.length(F.substring_index(first, "\n", -1)), F.lit(1), F.lit(0),
        F.lit(""), none(_PLACE), none(f"array<{_PLACES}>"),
    )

    def run_chunk(before: Column, chunk: Column) -> Column:
        kept = [before[n] for n in names[:-1]]
        return F.aggregate(
            F.transform(chunk, _part_facts(parts)),
            state(*kept, none(_PLACES)),
            _part_step(state, parts),
            lambda s: state(*(s[n] for n in names[:-1]), F.concat(before["done"], F.array(s["done"]))),
        )

    return F.aggregate(chunks, start, run_chunk, lambda s: F.sort_array(F.flatten(s["done"])))


def split_files(files: DataFrame) -> DataFrame:
    """Units of a table of files (``path``, ``content``); nothing is shuffled.

    A file that cannot be read (null content) or holds no declaration yields no unit; its row
    stays in the files table. Unit texts are cut from the lines of the file before the units
    become rows: cutting from the whole text, or carrying it along, would cost the square of
    the file size.
    """
    content = F.col("content")
    staged = files.select("path", "content", has_expressions(content).alias("_brackets"))
    staged = staged.select("path", F.split(content, "\n").alias("_lines"), "_brackets", source_parts(content, F.col("_brackets")).alias("_parts"))
    staged = staged.select("path", "_lines", unit_spans(F.col("_parts"), F.col("_brackets")).alias("_spans"))

    def ahead(span: Column, lines: int) -> Column:
        """What stands before the unit, from so many lines above it on."""
        first = F.greatest(F.lit(1), span["line"] - lines)
        before = F.array_join(F.slice("_lines", first, span["line"] - first + 1), "\n")
        rest = F.length(F.element_at("_lines", span["line"])) - span["col"]
        return bind(before, lambda text: F.substr(text, F.lit(1), F.length(text) - rest))

    def cut(span: Column) -> Column:
        text = F.array_join(F.slice("_lines", span["line"], span["end_line"] - span["line"] + 1), "\n")
        beyond = F.length(F.element_at("_lines", span["end_line"])) - span["end_col"]
        # a few lines mostly have as many characters as are asked for
        enough = lambda text: (F.length(text) >= fixed.DOC_COMMENT_LOOKBACK) | (span["line"] <= NEAR_LINES)
        near = lambda text: F.when(enough(text), text).otherwise(ahead(span, fixed.DOC_COMMENT_LOOKBACK))
        return F.struct(
            span["ordinal"].alias("ordinal"), span["name"].alias("name"), span["kind"].alias("kind"),
            span["line"].alias("start_line"), span["end_line"].alias("end_line"),
            F.right(bind(ahead(span, NEAR_LINES), near), F.lit(fixed.DOC_COMMENT_LOOKBACK)).alias("prefix"),
            bind(text, lambda whole: F.substr(whole, span["col"] + 1, F.length(whole) - span["col"] - beyond)).alias("code"),
        )

    staged = staged.select("path", F.transform("_spans", cut).alias("_units"))
    return large_enough(explode_once(staged, "path", items=F.col("_units"), name="u").select("path", "u.*"))


def large_enough(units: DataFrame) -> DataFrame:
    """Units of at least three code lines."""
    return units.filter(tx.code_lines(F.col("code")) >= MIN_LOC)


def unit_id(path: Column, start_line: Column, end_line: Column, name: Column) -> Column:
    return digest(12, path, start_line, end_line, name)


def has_doc_comment(prefix: Column) -> Column:
    return prefix.rlike(fixed.DOC_COMMENT_BEFORE)


def comment_ratio(comment_lines: Column, loc: Column) -> Column:
    return comment_lines / F.greatest(F.lit(1), loc + comment_lines)


def parameters(code: Column) -> Column:
    """Parameter names of the head of a unit (lexical)."""
    bare = tx.without_literals(code)
    inside = F.regexp_extract(bare, rf"^[^({{]*\(((?:[^()]++|\([^()]*+\))*+)\)", 1)
    pieces = F.filter(F.split(inside, ","), lambda p: p.rlike(r"[A-Za-z_$]"))
    return F.transform(pieces, lambda p: F.regexp_extract(p, r"([A-Za-z_$][A-Za-z0-9_$]*)", 1))


_BRANCH_WORDS = rf"(?<![A-Za-z0-9_$.])(?:if|for|while|case){fixed.WORD_END}"
_BRANCH_OPERATORS = r"\?\?(?!=)|\|\|(?!=)|&&(?!=)"


def complexity(code: Column) -> Column:
    """1 + branch words and short-circuit operators (lexical)."""
    bare = tx.without_literals(code)
    return F.lit(1) + tx.hits(bare, f"{_BRANCH_WORDS}|{_BRANCH_OPERATORS}")


_NESTING_PARTS = rf"(?<![A-Za-z0-9_$.])(?:if|for|while|switch|try){fixed.WORD_END}|[{{}};]"


def nesting_depth(code: Column) -> Column:
    """Deepest nesting of if, for, while, switch and try (lexical).

    Folds over heads and braces. A stack text holds one letter per open brace: ``c`` for the
    block of a control head, ``o`` for any other. A head without braces counts until the
    statement ends.
    """
    # the semicolons of a classic for head are no statement ends
    bare = F.regexp_replace(tx.without_literals(code), r"(?<![A-Za-z0-9_$.])for\s*\([^(){}]*\)", "for ")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("waiting"), F.lit(0).alias("best"))

    def step(s: Column, part: Column) -> Column:
        brace, shut, end = part == "{", part == "}", part == ";"
        head = ~(brace | shut | end)
        depth = F.length(F.replace(s["open"], F.lit("o"), F.lit("")))
        waiting = F.when(head, s["waiting"] + 1).otherwise(F.lit(0))
        opened = (
            F.when(brace & (s["waiting"] > 0), F.concat(s["open"], F.repeat(F.lit("c"), s["waiting"] - 1), F.lit("c")))
            .when(brace, F.concat(s["open"], F.lit("o")))
            .when(shut, F.substr(s["open"], F.lit(1), F.length(s["open"]) - 1))
            .otherwise(s["open"])
        )
        best = F.when(head, F.greatest(s["best"], depth + s["waiting"] + 1)).otherwise(s["best"])
        return F.struct(opened.alias("open"), waiting.alias("waiting"), best.alias("best"))

    return F.aggregate(tx.every(bare, _NESTING_PARTS), start, step, lambda s: s["best"])


def with_features(units: DataFrame) -> DataFrame:
    """Unit table plus ``id`` and the metadata columns of §1."""
    code = F.col("code")
    counted = units.select(
        "*",
        tx.code_lines(code).alias("loc"),
        tx.comment_lines(code).alias("comment_lines"),
        tx.identifiers(code).alias("identifiers"),
        nesting_depth(code).alias("nesting_depth"),
        parameters(code).alias("parameters"),
        has_doc_comment(F.col("prefix")).alias("has_doc"),
        complexity(code).alias("complexity"),
    )
    return counted.select(
        unit_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name")).alias("id"),
        "*",
        comment_ratio(F.col("comment_lines"), F.col("loc")).alias("comment_ratio"),
    )
