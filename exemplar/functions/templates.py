"""Prompt templates and suffixes (fixed values) and a Column renderer.

Templates are rendered as ``concat`` of literal pieces and columns, so no
string formatting happens in Python and no join is needed: the language is
dispatched with a ``when`` chain.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import cached_column

# Generation templates per language and mode, and test suffixes.
PROMPTS = {
    "Rust": {
        "instruct": "{function_code}\nGenerate Rust unittest for `{function_name}` function in module `{file_path}`:\n",
        "base": "{function_code}\n// Check the correcness for {function_name} function in Rust\n",
    },
    "Julia": {
        "instruct": "{function_code}\nGenerate Julia unittest for `{function_name}` function in module `{file_path}`:\n",
        "base": "{function_code}\n# Check the correcness for {function_name} function in Julia\n",
    },
    "Go": {
        "instruct": "{function_code}\nGenerate Go unittest for `{function_name}` function in module `{file_path}`:\n",
        "base": "{function_code}\n// Check the correcness for {function_name} function in Go\n",
    },
}
SUFFIXES = {
    "Rust": "    #[test]\n    fn test_{function_name}() {",
    "Julia": '@testset "{function_name} Tests" begin',
    "Go": "func Test{function_name}(",
}
# Template of fine-tuned base models: code then an opening language test tag.
FINETUNE = "{function_code}\n<{lang_lower}_test>\n"
SYSTEM_PROMPT = "You are a helpful coding assistant. Your task is to generate unittest for a given function."

FEWSHOT_HEADER = "Given the following related examples:\n\n"
RAG_OPEN, RAG_CLOSE = "#RELEVANT CONTEXT\n", "\n#END_OF_CONTEXT\n\n"
FILE_OPEN, FILE_CLOSE = "\n#CURRENT FILE: ", "\n#ENDFILE\n"

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """Column equivalent of ``template.format(**fields)``; null fields render as ''."""
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        parts.append(F.coalesce(fields[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def by_language(lang: Column, per_lang: Mapping[str, Column]) -> Column:
    expr = None
    for name, value in per_lang.items():
        same = F.lower(lang) == name.lower()
        expr = F.when(same, value) if expr is None else expr.when(same, value)
    return expr


@cached_column
def template_for(lang: Column, mode: str, fields: Mapping[str, Column]) -> Column:
    """The language's template ('instruct', 'base' or 'finetune')."""
    if mode == "finetune":
        return by_language(
            lang, {l: render(FINETUNE, {**fields, "lang_lower": F.lit(l.lower())}) for l in PROMPTS}
        )
    return by_language(lang, {l: render(t[mode], fields) for l, t in PROMPTS.items()})


@cached_column
def suffix_for(lang: Column, function_name: Column) -> Column:
    """T8."""
    return by_language(lang, {l: render(s, {"function_name": function_name}) for l, s in SUFFIXES.items()})
