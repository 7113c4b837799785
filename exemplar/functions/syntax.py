"""Syntax nodes of source texts: the nesting tree of function headers, modules, imports, attributes and comments.

The lexer blanks comments and literals; one pass over the brackets (braces, and in
Julia the blocks that ``end`` closes) and the headers between them then gives every item its
depth, its extent and the functions and modules around it.  Breadth-first order is the
order by (depth, start), so "the first function" and "children of the file" are Column
expressions over the array of nodes (``by_depth``, ``of_kind``).

Kinds: function, method (Go, with a receiver), declaration (a header without a body), module,
import, attribute, comment.  A function whose body never closes is no node (what stands in it counts as
inside a function); a module that never closes ends with the text; an import that does not end is none.  Closing brackets without an opening one lower the depth
and close nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexer
from .lexer import _col, _lang, shipped

LANGS = ("rust", "go", "julia", "java")

_RUST = re.compile(r"[{}()\[\];]|#!?\[|\b(?:fn\s+(?P<function>[A-Za-z_]\w*)|mod\s+(?P<module>\w+)|(?P<import>use)\s)")
#: What may stand before fn, mod and use and belongs to the item.
_RUST_BEFORE = re.compile(r"(?:\bpub(?:\s*\([^()]*\))?\s+)?(?:\b(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*\Z")
_RUST_BEFORE_ENDS = frozenset('bcent)"')  # the last letters of what it may be
_GO = re.compile(
    r"[{}()\[\]]|\b(?:func\s+(?P<receiver>\([^)]*\)\s*)?(?P<function>[A-Za-z_]\w*)|(?P<import>import)\b[ \t]*(?=[\"(\w._]))"
)
_JULIA = re.compile(
    r"(?m)[(){}\[\]]"
    r"|(?<![:.\w@])(?:function\s+(?P<function>[A-Za-z_]\w*)(?:\.[A-Za-z_]\w*|!)*"
    r"|(?P<open>function|macro|module|baremodule|if|for|while|let|begin|try|struct|do|quote|(?:abstract|primitive)\s+type)\b|(?P<end>end)\b)"
    r"|^[ \t]*(?:(?P<import>import|using)\s|(?P<short>[A-Za-z_][\w!]*)(?=\())"
)
_JAVA = re.compile(
    r"(?m)[{}()\[\];]|\b(?:public|private|protected|static)\b[^;{}=()]*?\b(?P<name>[A-Za-z_]\w*)\s*(?=\()"
    r"|^[ \t]*(?:[A-Za-z_][\w.<>\[\]]*[ \t]+)+(?P<plain>[A-Za-z_]\w*)[ \t]*(?=\()"
)
#: Words that stand before a parenthesis without being a function's name.
_NO_NAMES = frozenset(("if", "for", "while", "switch", "catch", "synchronized", "function", "fn", "func", "return", "new", "else", "throw"))
_JAVA_BODY = re.compile(r"\s*(?:throws\s+[\w.,\s]+)?(\{)")
_RUST_CALLABLE, _GO_CALLABLE, _JULIA_CALLABLE = re.compile(r"\s*[<(]"), re.compile(r"\s*[\[(]"), re.compile(r"\s*[{(]")
_SHORT_BODY = re.compile(r"[ \t]*(?:where[^\n=]*)?=(?!=)")
_GO_TYPE = re.compile(r"\b(?:interface|struct)\s*\Z")
_GO_IMPORT = re.compile(r'(?:[\w.]+[ \t]+)?"[^"\n]*"')
_BLANK = re.compile(r"\s*\Z")


class Node:
    """An item with its place in the tree; ``body`` is where its block opens."""

    __slots__ = ("kind", "name", "depth", "functions", "modules", "start", "stop", "body", "header", "marked", "asserts", "title", "text")

    def __init__(self, kind: str, name: str, depth: int, functions: int, modules: int, start: int, header: int) -> None:
        self.kind, self.name, self.depth, self.functions, self.modules = kind, name, depth, functions, modules
        self.start, self.stop, self.body, self.header = start, -1, -1, header


def nodes(text: str, lang: str) -> tuple[list[Node], str]:
    """The nodes of a text in the order of their ends, and the text with comments and literals blank."""
    found = lexer.spans(text, lang)
    code = lexer.blanked(text, found)
    out = _Tree()
    _SCAN[lang](code, out)
    items = out.closed
    for _, item in out.blocks:
        if item is not None and item.kind == "module":  # a file cut off within a module
            item.stop = len(text)
            items.append(item)
    for kind, start, stop in found:
        if kind in (lexer.LINE, lexer.BLOCK):
            comment = Node("comment", kind, 0, 0, 0, start, start)
            comment.stop = stop
            items.append(comment)
    _place_comments(items, out)
    return items, code


class _Tree:
    """Open blocks while a text is read, and the nodes that are done."""

    def __init__(self) -> None:
        self.depth = 0
        self.functions = self.modules = 0
        self.blocks: list[tuple[int, Node | None]] = []  # (depth before it, its item)
        self.closed: list[Node] = []
        self.headers: list[Node] = []  # of functions and methods, closed or not

    def node(self, kind: str, name: str, start: int, header: int) -> Node:
        item = Node(kind, name, self.depth, self.functions, self.modules, start, header)
        if kind in ("function", "method"):
            self.headers.append(item)
        return item

    def leaf(self, kind: str, name: str, start: int, stop: int, header: int = -1, body: int = -1) -> None:
        item = self.node(kind, name, start, header)
        item.stop, item.body = stop, body
        self.closed.append(item)

    def open(self, at: int, item: Node | None) -> None:
        if item is not None:
            item.body = at
            self.functions += item.kind in ("function", "method")
            self.modules += item.kind == "module"
        self.blocks.append((self.depth, item))
        self.depth += 1

    def close(self, stop: int) -> None:
        self.depth -= 1
        # a bracket too many closes the innermost block whose depth it undercuts
        while self.blocks and self.blocks[-1][0] >= self.depth:
            _, item = self.blocks.pop()
            if item is not None:
                self.functions -= item.kind in ("function", "method")
                self.modules -= item.kind == "module"
                item.stop = stop
                self.closed.append(item)


def _place_comments(items: list[Node], tree: _Tree) -> None:
    """Gives comments the number of functions around them, closed or not."""
    blocks = [(n.body, n.stop) for n in items if n.kind in ("function", "method") and n.body >= 0]
    blocks += [(n.body, 1 << 62) for _, n in tree.blocks if n is not None and n.kind in ("function", "method")]
    marks = sorted([(a, 1) for a, _ in blocks] + [(b, -1) for _, b in blocks])
    at = inside = 0
    for n in sorted((n for n in items if n.kind == "comment"), key=lambda n: n.start):
        while at < len(marks) and marks[at][0] <= n.start:
            inside += marks[at][1]
            at += 1
        n.functions = inside


def _rust_start(code: str, at: int) -> int:
    """Where the item of a keyword begins: at its visibility and qualifiers, if it has any."""
    window = code[max(0, at - 200) : at]
    if window.rstrip()[-1:] not in _RUST_BEFORE_ENDS:
        return at
    return at - len(window) + _RUST_BEFORE.search(window).start()


def _scan_rust(code: str, tree: _Tree) -> None:
    waiting: Node | None = None  # a header whose body has not opened
    parens = floor = 0
    at = declared = 0
    for m in _RUST.finditer(code):
        sign, name = m.group(), m.lastgroup
        if m.start() < at or (name is not None and m.start() < declared):  # brackets of a declaration count, words do not
            continue
        if name == "import":
            stop = code.find(";", m.end())
            if stop >= 0:
                declared = stop + 1
                tree.leaf("import", "", _rust_start(code, m.start()), declared)
        elif name is not None:
            if name == "module" or _RUST_CALLABLE.match(code, m.end()):
                waiting, floor = tree.node(name, m.group(name), _rust_start(code, m.start()), m.end()), parens
        elif sign in "([":
            parens += 1
        elif sign in ")]":
            parens -= 1
        elif sign == "{":
            own = waiting if parens <= floor else None
            tree.open(m.start(), own)
            waiting = None if own is not None else waiting
        elif sign == "}":
            tree.close(m.end())
        elif sign == ";":
            if waiting is not None and parens <= floor:
                waiting.kind = "declaration" if waiting.kind == "function" else waiting.kind
                waiting.stop = m.end()
                tree.closed.append(waiting)
                waiting = None
        else:
            at = _matching(code, m.end() - 1, "[", "]")
            tree.leaf("attribute", "", m.start(), at)


def _scan_go(code: str, tree: _Tree) -> None:
    waiting: Node | None = None
    parens = floor = 0
    at = 0
    for m in _GO.finditer(code):
        if m.start() < at:
            continue
        sign, name = m.group(), m.lastgroup
        if name == "function":
            if not _GO_CALLABLE.match(code, m.end()) or (waiting is not None and parens > floor):  # the type of a parameter
                continue
            kind = "method" if m.group("receiver") else "function"
            waiting, floor = tree.node(kind, m.group("function"), m.start(), m.end()), parens
        elif name == "import":
            if tree.depth == 0 and (one := _GO_IMPORT.match(code, m.end())) is not None:
                at = one.end()
                tree.leaf("import", "", m.start(), at)
            elif tree.depth == 0 and code.startswith("(", m.end()):
                at = _matching(code, m.end(), "(", ")")
                if code[at - 1] == ")":
                    tree.leaf("import", "", m.start(), at)
        elif sign in "([":
            parens += 1
        elif sign in ")]":
            parens -= 1
        elif sign == "{":
            own = waiting if parens <= floor else None
            # interface{} and struct{...} in a signature open no body
            if own is not None and _GO_TYPE.search(code[max(own.header, m.start() - 12) : m.start()]):
                own = None
            tree.open(m.start(), own)
            waiting = None if own is not None else waiting
        else:
            tree.close(m.end())


def _scan_julia(code: str, tree: _Tree) -> None:
    brackets = 0
    at = 0
    for m in _JULIA.finditer(code):
        if m.start() < at:
            continue
        sign, name = m.group(), m.lastgroup
        if name is None:
            brackets = max(0, brackets + (1 if sign in "([{" else -1))
            continue
        if name == "function" and (m.start() == 0 or code[m.start() - 1] == "\n"):
            brackets = 0  # none of what stands before was closed
        if brackets:  # end is an index there, for and if belong to comprehensions
            continue
        if name == "function":
            called = _JULIA_CALLABLE.match(code, m.end()) is not None
            tree.open(m.end(), tree.node("function", m.group(name), m.start(), m.end()) if called else None)
        elif name == "short":
            stop = _matching(code, m.end(), "(", ")")
            body = _SHORT_BODY.match(code, stop)
            if m.group(name) not in _NO_NAMES and body is not None and "\n" not in code[m.end() : stop]:
                tree.leaf("function", m.group(name), m.start(name), lexer._find(code, "\n", body.end()), m.end(), body.end())
                at = body.end()
        elif name == "import":
            start, stop = m.start(name), lexer._find(code, "\n", m.end())
            while code[start:stop].rstrip().endswith(",") and stop < len(code):
                stop = lexer._find(code, "\n", stop + 1)
            at = start + len(code[start:stop].rstrip())
            if not code[start:at].endswith(","):
                tree.leaf("import", "", start, at)
        elif name == "open":
            tree.open(m.end(), None)
        else:
            tree.close(m.end())


def _scan_java(code: str, tree: _Tree) -> None:
    waiting: dict[int, Node] = {}
    at = 0
    for m in _JAVA.finditer(code):
        if m.start() < at:
            continue
        sign, name = m.group(), m.lastgroup
        if name is not None:
            body = _JAVA_BODY.match(code, _matching(code, m.end(), "(", ")"))
            if body is not None and not _NO_NAMES.intersection(sign.split()):
                start = m.start() + len(sign) - len(sign.lstrip())
                waiting[body.start(1)] = tree.node("function", m.group(name), start, m.end())
                at = body.start(1)
        elif sign == "{":
            tree.open(m.start(), waiting.pop(m.start(), None))
        elif sign == "}":
            tree.close(m.end())


def _matching(code: str, at: int, opens: str, closes: str) -> int:
    """Behind the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(opens)}{re.escape(closes)}]").finditer(code, at):
        depth += 1 if m.group() == opens else -1
        if depth == 0:
            return m.end()
    return len(code)


_SCAN = {"rust": _scan_rust, "go": _scan_go, "julia": _scan_julia, "java": _scan_java}


# -------------------------------------------------------------- parameters --

_SIGN = re.compile(r"->|=>|<-|<=|>=|[()\[\]{}<>,;]")
_RUST_SELF = re.compile(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self")


def parameters(code: str, at: int, lang: str) -> list[str]:
    """Items of the first parenthesised list behind ``at``, without what their brackets hold; type parameters are skipped.

    A list that is cut off counts as far as it goes; Julia's ends at ``;`` too."""
    depth, inside, start, items, parts = 0, False, at, [], []
    for m in _SIGN.finditer(code, at):
        sign = m.group()
        if not inside:
            if sign == "(" and depth == 0:
                inside, start = True, m.end()
            elif sign in ("[", "{", "<", "("):
                depth += 1
            elif sign in ("]", "}", ">", ")"):
                depth = max(0, depth - 1)
            continue
        if depth == 0 and (sign == ")" or sign == ";" and lang == "julia"):
            items.append("".join(parts) + code[start : m.start()])
            return [x.strip() for x in items if x.strip()]
        if depth == 0 and sign == ",":
            items.append("".join(parts) + code[start : m.start()])
            start, parts = m.end(), []
        elif sign in ("[", "{", "<", "("):
            if depth == 0:
                parts.append(code[start : m.start()])
            depth += 1
        elif sign in ("]", "}", ">", ")"):
            depth = max(0, depth - 1)
            if depth == 0:
                start = m.end()
    if inside:
        items.append("".join(parts) + (code[start:] if depth == 0 else ""))
    return [x.strip() for x in items if x.strip()]


def counted(items: list[str], lang: str) -> int:
    """Parameters that count: no ``self`` in Rust, declarations in Go, no defaults in Julia, variadic ones nowhere."""
    items = [x for x in items if "..." not in x]
    if lang == "rust":
        return sum(1 for x in items if not _RUST_SELF.fullmatch(x))
    if lang == "go" and any(" " in x for x in items):
        return sum(1 for x in items if " " in x)
    if lang == "julia":
        return sum(1 for x in items if "=" not in x)
    return len(items)


# ---------------------------------------------------------------- features --

#: Without these a text holds no function of the language.
_NEEDS = {"rust": "fn", "go": "func", "julia": "(", "java": "{"}


def first_function(text: str, lang: str) -> tuple[Node, str] | None:
    """The first function breadth-first, closed or not, with or without a body."""
    if _NEEDS[lang] not in text:
        return None
    found = lexer.spans(text, lang)
    code = lexer.blanked(text, found)
    tree = _Tree()
    _SCAN[lang](code, tree)
    return (min(tree.headers, key=lambda n: (n.depth, n.start)), code) if tree.headers else None


def features(text: str | None, lang: str | None = None) -> dict | None:
    """Language (detected unless given), name and parameter count of the first function, and its receiver's declarations (Go)."""
    if text is None:
        return None
    for one in (lang,) if lang else LANGS:
        found = first_function(text, one) if one in _NEEDS else None
        if found is not None:
            item, code = found
            n = counted(parameters(code, item.header, one), one)
            receiver = None
            if item.kind == "method":
                receiver = counted(parameters(code, item.start, one), one)
            return {"lang": one, "name": item.name, "params": n, "receiver": receiver}
    return {"lang": lang, "name": "", "params": None, "receiver": None}


# -------------------------------------------------------------- Arrow side --

NODE = {
    "kind": "string", "name": "string", "depth": "int", "functions": "int", "modules": "int", "start": "int", "stop": "int", "body": "int",
    "marked": "boolean", "asserts": "boolean", "title": "string", "text": "string",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
FEATURES = "struct<lang:string,name:string,params:int,receiver:int>"


def rows(text: str | None, lang: str | None, kinds: tuple[str, ...] = ()) -> list[Node]:
    """The nodes of a text (of these kinds, if given) by start, with what is read off the text.

    ``marked``: ``#[test]`` stands right before; ``asserts``: the body holds "assert"; ``title``: the first line.
    ``text`` is given for what does not nest: outermost functions, imports, attributes and comments."""
    if not text or lang not in LANGS:
        return []
    found, _ = nodes(text, lang)
    ends = sorted(n.stop for n in found if n.kind == "attribute" and text[n.start : n.stop] == "#[test]")
    out = sorted((n for n in found if not kinds or n.kind in kinds), key=lambda n: (n.start, n.stop))
    for n in out:
        block = n.kind in ("function", "method")
        n.marked = block and bool(ends) and _marked(text, ends, n.start)
        n.asserts = block and text.find("assert", n.body, n.stop) >= 0
        n.title = text[n.start : min(n.stop, lexer._find(text, "\n", n.start))] if block else None
        n.text = text[n.start : n.stop] if n.kind in ("import", "attribute", "comment") or (block and n.functions == 0) else None
    return out


def _marked(text: str, ends: list[int], start: int) -> bool:
    i = bisect_right(ends, start)
    return i > 0 and _BLANK.match(text, ends[i - 1], start) is not None


def _node_lists(found: list[list[Node] | None], fields: tuple[str, ...]) -> pa.Array:
    """Lists of nodes, column by column."""
    flat = [n for ns in found if ns for n in ns]
    columns = [pa.array([getattr(n, f) for n in flat], _ARROW[NODE[f]]) for f in fields]
    return _lists(found, pa.StructArray.from_arrays(columns, names=list(fields)))


def _lists(found: list, values: pa.Array) -> pa.Array:
    offsets, at = [], 0
    for xs in found:
        offsets.append(None if xs is None else at)
        at += 0 if xs is None else len(xs)
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


#: Bytes of texts whose nodes are Python objects at a time; a node takes many times what it takes in Arrow.
PIECE_BYTES = 1 << 20


def _in_pieces(run):
    """``run`` over pieces of a batch of about ``PIECE_BYTES`` (a row at least), so nodes of a whole batch are never held."""

    def pieces(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        step = max(1, n * PIECE_BYTES // max(1, columns[0].nbytes))
        return pa.concat_arrays([run(*(c.slice(at, step) for c in columns)) for at in range(0, max(n, 1), step)])

    return pieces


def _rows_batch(kinds: tuple[str, ...], fields: tuple[str, ...]):
    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        return _node_lists([rows(t, s, kinds) for t, s in zip(text.to_pylist(), lang.to_pylist())], fields)

    return _in_pieces(run)


def _rows_each_batch(kinds: tuple[str, ...], fields: tuple[str, ...]):
    def run(texts: pa.Array, lang: pa.Array) -> pa.Array:
        found = [None if ts is None else [rows(t, s, kinds) for t in ts] for ts, s in zip(texts.to_pylist(), lang.to_pylist())]
        return _lists(found, _node_lists([ns for each in found if each for ns in each], fields))

    return _in_pieces(run)


def _features_batch(text: pa.Array, lang: pa.Array) -> pa.Array:
    out = [features(t, s) for t, s in zip(text.to_pylist(), lang.to_pylist())]
    return pa.array(out, pa.struct([("lang", pa.string()), ("name", pa.string()), ("params", pa.int32()), ("receiver", pa.int32())]))


def without(text: str | None, cuts: list[dict] | None) -> str | None:
    """A text without its cuts, given by start.  A cut of whole lines takes its lines and their breaks if nothing else stands there."""
    if not text or not cuts:
        return text
    text += "\n"  # every line has a break
    out, at = [], 0
    for cut in sorted(cuts, key=lambda c: (c["start"], -c["stop"])):
        start, stop = cut["start"], cut["stop"]
        if stop <= at:
            continue
        start = max(start, at)
        if cut["whole"]:
            first, last = text.rfind("\n", 0, start) + 1, text.find("\n", stop)
            if _BLANK.match(text, first, start) and _BLANK.match(text, stop, last):
                start, stop = max(first, at), last + 1
        out.append(text[at:start])
        at = stop
    return ("".join(out) + text[at:]).removesuffix("\n")


def _without_batch(text: pa.Array, cuts: pa.Array) -> pa.Array:
    return pa.array([without(t, c) for t, c in zip(text.to_pylist(), cuts.to_pylist())], pa.string())


def _type(fields: tuple[str, ...]) -> str:
    return f"array<struct<{','.join(f'{f}:{NODE[f]}' for f in fields)}>>"


def syntax_nodes(text, lang, kinds: tuple[str, ...] = (), fields: tuple[str, ...] = tuple(NODE)) -> Column:
    """Nodes of a text in a language (a name or a column), by start: all kinds and fields, or those that are asked for."""
    shipped()
    return F.arrow_udf(_rows_batch(kinds, fields), _type(fields))(_col(text), _lang(lang))


def syntax_nodes_each(texts, lang, kinds: tuple[str, ...] = (), fields: tuple[str, ...] = tuple(NODE)) -> Column:
    """Nodes of every text of an array."""
    shipped()
    return F.arrow_udf(_rows_each_batch(kinds, fields), f"array<{_type(fields)}>")(_col(texts), _lang(lang))


def first_features(text, lang=None) -> Column:
    shipped()
    return F.arrow_udf(_features_batch, FEATURES)(_col(text), F.lit(None).cast("string") if lang is None else _lang(lang))


def without_spans(text, cuts) -> Column:
    """A text without the spans ``array<struct<start,stop,whole>>``."""
    shipped()
    return F.arrow_udf(_without_batch, "string")(_col(text), cuts)


# ------------------------------------------------------------- node finders --


def of_kind(found: Column, *kinds: str) -> Column:
    """The nodes of these kinds."""
    return F.filter(found, lambda n: n["kind"].isin(*kinds))


def by_depth(found: Column) -> Column:
    """Breadth-first order."""
    key = F.transform(found, lambda n: F.struct(n["depth"].alias("depth"), n["start"].alias("start"), n.alias("node")))
    return F.transform(F.array_sort(key), lambda k: k["node"])


def children(found: Column, of: Column) -> Column:
    """The nodes directly below the node ``of`` (a block deeper, within its extent)."""
    return F.filter(found, lambda n: (n["start"] > of["start"]) & (n["stop"] <= of["stop"]) & (n["depth"] == of["depth"] + 1))
