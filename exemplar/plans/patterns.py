"""Patterns of the oracle's SQL for code texts.

The queries themselves read a nesting tree (``functions.syntax``); the oracle folds lines and
tokens with these patterns instead, so both agree only where the answer does not depend on
the way it is found.  Look-arounds and back-references are avoided (RE2).
"""

from __future__ import annotations

from ..functions.text import MAX_TESTS, RUST_TEST_PREFIX, TEST_ATTRS  # noqa: F401

LANGS = ("rust", "go", "julia", "java")

# Function headers, tried in this order.
HEADER = {
    "rust": r"\bfn\s+[A-Za-z_]\w*\s*[<(]",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?[A-Za-z_]\w*\s*[\[(]",
    "julia": r"\bfunction\s+[A-Za-z_][\w.!]*\s*[{(]",
    "java": r"\b(?:public|private|protected|static)\b[^;{=()]*?\b[A-Za-z_]\w*\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\{",
}

# Method name: first capture group.
NAME = {
    "rust": r"\bfn\s+([A-Za-z_]\w*)",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "julia": r"\bfunction\s+([A-Za-z_]\w*)",
    "java": r"\b(?:public|private|protected|static)\b[^;{=()]*?\b([A-Za-z_]\w*)\s*\(",
}

# Forms without the keyword: Julia ``name(args) = body`` and Java methods without a modifier.
JULIA_SHORT = r"(?m)^[ \t]*([A-Za-z_][\w!]*)\((?:[^\n()]|\([^\n()]*\))*\)[ \t]*(?:where[^\n=]*)?=[^=]"
JAVA_PLAIN = r"(?m)^[ \t]*(?:[A-Za-z_][\w.<>\[\]]*[ \t]+)+([A-Za-z_]\w*)[ \t]*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\{"
SHORT = {"julia": JULIA_SHORT, "java": JAVA_PLAIN}
NOT_NAMES = ("if", "for", "while", "switch", "catch", "synchronized", "function", "fn", "func")

# What follows the name of the first function, up to the end of the text.
AFTER_NAME = {
    "rust": r"(?s)\bfn\s+[A-Za-z_]\w*(.*)",
    "go": r"(?s)\bfunc\s+(?:\([^)]*\)\s*)?[A-Za-z_]\w*(.*)",
    "julia": r"(?s)\bfunction\s+[A-Za-z_][\w.!]*(.*)",
    "java": r"(?s)\b(?:public|private|protected|static)\b[^;{=()]*?\b[A-Za-z_]\w*\s*(\(.*)",
}
AFTER_SHORT = {
    "julia": r"(?s)(?:^|\n)[ \t]*[A-Za-z_][\w!]*(\((?:[^\n()]|\([^\n()]*\))*\)[ \t]*(?:where[^\n=]*)?=[^=].*)",
    "java": r"(?s)(?:^|\n)[ \t]*(?:[A-Za-z_][\w.<>\[\]]*[ \t]+)+[A-Za-z_]\w*[ \t]*(\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\{.*)",
}

# Tokens of a parameter list: arrows and comparisons (whose signs are no brackets), brackets and separators, runs of the rest.
TOKEN = r"->|=>|<-|<=|>=|[()\[\]{}<>,;]|[^()\[\]{}<>,;=-]+|[=-]"
OPEN, CLOSE = "([{<", ")]}>"
RUST_SELF = r"^(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self$"
TRIM = r"^\s+|\s+$"

# Lines.
_STRING = r'"(?:\\.|[^"\\])*"'
_CHAR = r"'(?:\\.|[^'\\])'"
_LINE_COMMENT = r"//.*$"
RUST_FN = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+[A-Za-z_]\w*"
RUST_TEST_MOD = r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+\w*test\w*"
GO_FUNC = r"^func\s+[A-Za-z_]\w*"
#: "No open segment": depths themselves may fall below 0 in broken texts.
NO_DEPTH = -(1 << 30)
#: A line that ends a declaration without a body.
_SEMI_END = r";\s*$"
#: Attributes in front of an item on its own line.
_ATTRS_BEFORE = r"^\s*(?:#\[[^\]]*\]\s*)+"

_IMPORT_START = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s",
    "go": r"^import\b",
    "julia": r"^\s*(?:import|using)\s",
}

#: Comments that mention test or assert, and (group 1) what may hold their marks and stays: strings and other comments.
_TEST_COMMENTS = (
    r"//[^\n]*?(?:test|assert)[^\n]*"
    r"|/\*(?:[^*]*\*+[^*/])*?[^*]*?(?:test|assert)[^*]*(?:\*+[^*/][^*]*)*\*+/"
    r"|(\"(?:\\.|[^\"\\])*\"|//[^\n]*|/\*[^*]*\*+(?:[^*/][^*]*\*+)*/)"
)
