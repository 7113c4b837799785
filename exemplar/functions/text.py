"""Tests, imports and stripped files from source texts.

``syntax`` gives the nodes of a text (functions, modules, imports, attributes, comments with
their place in the nesting tree); which of them count, in which order, and how they are put
together is said here in Column expressions over the array of nodes.  Everything is per row,
without a shuffle, and linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import cached_column
from .syntax import by_depth, syntax_nodes, syntax_nodes_each, without_spans

TEST_ATTRS = ("#[test]", "#[cfg(test)]")
RUST_TEST_PREFIX = "    #[test]\n    "
MAX_TESTS = 10
#: What X1 and X2 read of a text.
_FUNCTIONS = (("function",), ("depth", "functions", "start", "marked", "title", "text"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rust_tests(found: Column) -> Column:
    """X1 over the functions of a text."""
    outer = F.filter(found, lambda n: n["functions"] == 0)
    named = lambda n: (F.instr(n["title"], "test_") > 0) | (F.instr(n["title"], "_test") > 0)
    return F.transform(by_depth(F.filter(outer, lambda n: n["marked"] | named(n))), lambda n: F.concat(F.lit(RUST_TEST_PREFIX), n["text"]))


def _go_tests(found: Column) -> Column:
    """X2 over the functions of a text after the prefix rule."""
    keep = F.filter(found, lambda n: (n["depth"] == 0) & (F.instr(n["title"], "Test") > 0))
    return F.transform(keep, lambda n: n["text"])


@cached_column
def rust_tests(text) -> Column:
    """Test functions of one Rust response: functions right behind ``#[test]`` or
    whose first line has ``test_``/``_test``; nested functions are part of their
    parent; breadth-first order (depth, then position)."""
    return _rust_tests(syntax_nodes(text, "rust", *_FUNCTIONS))


def go_normalize(text) -> Column:
    """X2 prefix rule: drop what precedes the first ``func Test`` and restore
    it with the next letter upper-cased (the whole text when the marker is
    absent); empty text stays empty."""
    t = F.coalesce(_c(text), F.lit(""))
    rest = F.when(F.instr(t, "func Test") > 0, F.substring(t, F.instr(t, "func Test") + 9, 1 << 30)).otherwise(t)
    return F.when(F.length(rest) == 0, F.lit("")).otherwise(
        F.concat(F.lit("func Test"), F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30))
    )


@cached_column
def go_tests(text) -> Column:
    """Top-level ``func`` declarations (not methods) with a body and
    ``Test`` on their first line, after the prefix rule."""
    return _go_tests(syntax_nodes(go_normalize(text), "go", *_FUNCTIONS))


@cached_column
def julia_tests(text) -> Column:
    """``@testset`` plus everything after the first ``@testset`` (the
    whole text if there is none): always one entry."""
    t = F.coalesce(_c(text), F.lit(""))
    rest = F.when(F.instr(t, "@testset") > 0, F.substring(t, F.instr(t, "@testset") + 8, 1 << 30)).otherwise(t)
    return F.array(F.concat(F.lit("@testset"), rest))


@cached_column
def sanitize_responses(lang: Column, responses) -> Column:
    """X4 + W4: tests of all responses of a sample by its (lower-case) language (X1-X3; Julia's for others), in order, at most 10."""
    texts = _c(responses)
    read = F.transform(texts, lambda r: F.when(lang == "go", go_normalize(r)).when(lang == "rust", r))
    found = syntax_nodes_each(read, lang, *_FUNCTIONS)
    tests = (
        F.when(lang == "rust", F.transform(found, _rust_tests))
        .when(lang == "go", F.transform(found, _go_tests))
        .otherwise(F.transform(texts, julia_tests))
    )
    return F.slice(F.flatten(tests), 1, MAX_TESTS)


@cached_column
def raw_responses(prompt, responses) -> Column:
    """Each response prefixed by the last line of the prompt."""
    last = F.element_at(F.split(F.coalesce(_c(prompt), F.lit("")), "\n"), -1)
    return F.transform(_c(responses), lambda r: F.concat(last, r))


@cached_column
def import_context(lang: Column, text) -> Column:
    """Import statements in order, joined by newlines: Rust ``use`` declarations outside
    ``mod`` blocks, Go top-level ``import`` declarations (one or a block), Julia
    ``import``/``using`` (continued while a line ends with ``,``)."""
    found = F.filter(syntax_nodes(text, lang, ("import",), ("modules", "text")), lambda n: n["modules"] == 0)
    return F.array_join(F.transform(found, lambda n: n["text"]), "\n")


@cached_column
def strip_rust_tests(text) -> Column:
    """X6 (intent of the original): without ``mod`` items whose name contains
    ``test``, functions whose body contains ``assert``, ``#[test]`` and
    ``#[cfg(test)]`` attributes, and comments that mention test or assert.  What
    stands alone on its lines goes with them, but comments within functions and block
    comments leave their line.  Signatures without a body are no functions, an unclosed function is kept."""
    t = _c(text)
    found = syntax_nodes(t, "rust")
    says = lambda n, w: F.instr(n["text"], w) > 0
    outside = lambda n: n["functions"] == 0
    goes = F.filter(
        found,
        lambda n: ((n["kind"] == "module") & outside(n) & (F.instr(n["name"], "test") > 0))
        | ((n["kind"] == "function") & outside(n) & n["asserts"])
        | ((n["kind"] == "attribute") & outside(n) & n["text"].isin(*TEST_ATTRS))
        | ((n["kind"] == "comment") & (says(n, "test") | says(n, "assert"))),
    )
    whole = lambda n: ~((n["kind"] == "comment") & ((n["name"] == "block") | ~outside(n)))
    return without_spans(t, F.transform(goes, lambda n: F.struct(n["start"].alias("start"), n["stop"].alias("stop"), whole(n).alias("whole"))))
