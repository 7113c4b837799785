"""A finite-state lexer for Rust, Go, Julia and Java texts.

The states are code, line comment, block comment (with a nesting depth in Rust and
Julia), string, character, raw string (ended by its own delimiter) and back-tick
string.  From code, the next opener decides the state; each state knows where it ends,
so a text is read once from left to right.  What is left of an unclosed state is in it
up to the end of the text, or of the line where the language ends strings there.

Nesting and delimiters of free length are beyond regular expressions, and a fold with
SQL's ``aggregate`` copies what it has gathered at every step; so this is an Arrow function.
It only yields spans (and the nodes of ``syntax``): choosing, ordering and putting together is
left to Column expressions.

Offsets are 0-based code points, ends exclusive.  A null text has no spans; an unknown
language is lexed as Java.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LINE, BLOCK, STRING, CHAR, RAW, TICK = KINDS = ("line", "block", "string", "char", "raw", "tick")

#: What may open a state, by language.
_SIGNS = {"rust": re.compile(r"[/\"']"), "go": re.compile(r"[/\"'`]"), "java": re.compile(r"[/\"']"), "julia": re.compile(r"[#\"'`]")}
#: A character behind its quote; others are lifetimes in Rust and transpositions in Julia.
_CHAR = {
    "rust": re.compile(r"(?:\\.[^'\n]*|[^'\\\n])'"),
    "go": re.compile(r"(?:\\[^\n][^'\n]*|[^'\\\n])'"),
}
_CHAR |= {"java": _CHAR["go"], "julia": _CHAR["go"]}
#: What makes a quote that of a raw string in Rust, read backwards from it.
_RAW_PREFIX = re.compile(r"(#*)r[bc]?(?!\w)")
_TRANSPOSED = re.compile(r"[\w)\]}.']")
_NESTED = {"rust": re.compile(r"/\*|\*/"), "julia": re.compile(r"#=|=#")}
#: The rest of a string up to its quote; in Go and Java it ends with its line.
_STRING = {
    "rust": re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"?', re.S),
    "go": re.compile(r'[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"?'),
}
_STRING |= {"julia": _STRING["rust"], "java": _STRING["go"]}
#: Closed as they open; a backslash keeps the closing sign from counting.
_ESCAPED = {sign: re.compile(rf"[^{sign[0]}\\]*(?:(?:\\.|(?!{re.escape(sign)}){re.escape(sign[0])})[^{sign[0]}\\]*)*(?:{re.escape(sign)})?", re.S) for sign in ('"""', "`", "```")}


def spans(text: str, lang: str) -> list[tuple[str, int, int]]:
    """(state, start, end) of everything that is not code, in order."""
    lang = lang if lang in _SIGNS else "java"
    signs, at, out = _SIGNS[lang], 0, []
    while (found := signs.search(text, at)) is not None:
        start = found.start()
        opened = _opened(text, lang, start, found.group())
        if opened is None:
            at = start + 1
            continue
        out.append(opened)
        at = opened[2]
    return out


def _opened(text: str, lang: str, at: int, sign: str) -> tuple[str, int, int] | None:
    """The span that opens at a sign; None if it opens nothing."""
    two = text[at : at + 2]
    if two == ("#=" if lang == "julia" else "/*"):
        return BLOCK, at, _block_end(text, lang, at + 2)
    if two == "//" or sign == "#":
        return LINE, at, _find(text, "\n", at)
    if sign == "'":
        if lang == "julia" and at and _TRANSPOSED.match(text, at - 1):
            return None
        closed = _CHAR[lang].match(text, at + 1)
        return (CHAR, at, closed.end()) if closed else None
    if sign == "`" and lang == "go":
        return TICK, at, min(len(text), _find(text, "`", at + 1) + 1)
    if sign == "`":
        quote = "```" if text.startswith("```", at) else "`"
        return TICK, at, _ESCAPED[quote].match(text, at + len(quote)).end()
    if sign == '"' and lang in ("java", "julia") and text.startswith('"""', at):
        return RAW, at, _ESCAPED['"""'].match(text, at + 3).end()
    if sign == '"':
        before = _RAW_PREFIX.match(text[max(0, at - 300) : at][::-1]) if lang == "rust" else None
        if before:
            close = '"' + before.group(1)
            return RAW, at - before.end(), min(len(text), _find(text, close, at + 1) + len(close))
        return STRING, at, _STRING[lang].match(text, at + 1).end()
    return None


def _find(text: str, what: str, at: int) -> int:
    """Where ``what`` stands next; the end of the text if it does not."""
    found = text.find(what, at)
    return len(text) if found < 0 else found


def _block_end(text: str, lang: str, at: int) -> int:
    if lang not in _NESTED:
        return min(len(text), _find(text, "*/", at) + 2)
    depth = 1
    for mark in _NESTED[lang].finditer(text, at):
        depth += 1 if mark.group() in ("/*", "#=") else -1
        if depth == 0:
            return mark.end()
    return len(text)


_NOT_NEWLINE = re.compile(r"[^\n]")


def blanked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text as long as it was, with comments blank and only the outer quotes of strings; line breaks stay."""
    out, at = [], 0
    for kind, start, end in found:
        out.append(text[at:start])
        piece = _NOT_NEWLINE.sub(" ", text[start:end])
        out.append(piece if kind in (LINE, BLOCK) or end - start < 2 else f'"{piece[1:-1]}"')
        at = end
    out.append(text[at:])
    return "".join(out)


# ------------------------------------------------------------- Arrow side --


def shipped() -> None:
    """Sees to it that the workers of the active session can import this package."""
    from ..session import ship_package

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


SPAN = "struct<kind:string,start:int,stop:int>"


def _lex_batch(text: pa.Array, lang: pa.Array) -> pa.Array:
    rows = [[] if t is None else [{"kind": k, "start": a, "stop": b} for k, a, b in spans(t, s or "")] for t, s in zip(text.to_pylist(), lang.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))


def lexed(text, lang) -> Column:
    """The spans of comments and literals of a text as an array of structs."""
    shipped()
    return F.arrow_udf(_lex_batch, f"array<{SPAN}>")(_col(text), _lang(lang))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lang(lang) -> Column:
    return F.lit(lang) if isinstance(lang, str) else lang
