"""DuckDB text of the Column expressions in ``functions.code`` (oracle side).

Line and token folds with patterns of their own (``patterns``): another way to the answers
that the queries read off the nesting tree.
"""

from __future__ import annotations

from . import patterns as C


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _short_name(c: str, l: str) -> str:
    name = f"regexp_extract({c}, {_lit(C.SHORT[l])}, 1)"
    return f"(CASE WHEN {name} IN ({', '.join(map(_lit, C.NOT_NAMES))}) THEN '' ELSE {name} END)"


def _has_header(c: str, l: str) -> str:
    found = f"regexp_matches({c}, {_lit(C.HEADER[l])})"
    return f"({found} OR {_short_name(c, l)} <> '')" if l in C.SHORT else found


def detect_language(c: str) -> str:
    arms = " ".join(f"WHEN {_has_header(c, l)} THEN '{l}'" for l in C.LANGS)
    has = lambda s: f"instr({c}, {_lit(s)}) > 0"
    return (
        f"(CASE {arms}"
        f" WHEN {has('fn ')} OR {has('impl ')} OR {has('pub fn')} THEN 'rust'"
        f" WHEN {has('func ')} OR {has('package ')} THEN 'go'"
        f" WHEN {has('function ')} AND {has('end')} THEN 'julia'"
        f" WHEN ({has('public ')} OR {has('private ')}) AND ({has('class ')} OR {has('void ')} OR {has('int ')}) THEN 'java'"
        " END)"
    )


def _name(c: str, l: str) -> str:
    n = f"regexp_extract({c}, {_lit(C.NAME[l])}, 1)"
    return f"CASE WHEN regexp_matches({c}, {_lit(C.HEADER[l])}) THEN {n} ELSE {_short_name(c, l)} END" if l in C.SHORT else n


def method_name(c: str, lang: str) -> str:
    arms = " ".join(f"WHEN '{l}' THEN {_name(c, l)}" for l in C.LANGS)
    return f"coalesce((CASE {lang} {arms} END), '')"


def _items(l: str, c: str) -> str:
    after = f"regexp_extract({c}, {_lit(C.AFTER_NAME[l])}, 1)"
    if l in C.AFTER_SHORT:
        after = f"CASE WHEN regexp_matches({c}, {_lit(C.HEADER[l])}) THEN {after} ELSE regexp_extract({c}, {_lit(C.AFTER_SHORT[l])}, 1) END"
    signs = lambda x: "(" + ", ".join(_lit(ch) for ch in x) + ")"
    stop = signs(");" if l == "julia" else ")")
    flat = "s.phase = 1 AND s.depth = 0"
    begins = "(s.phase = 0 AND s.depth = 0 AND t.t = '(')"
    ends, comma = f"({flat} AND t.t IN {stop})", f"({flat} AND t.t = ',')"
    here = f"({flat} AND t.t NOT IN {signs(C.OPEN + C.CLOSE + ',')} AND NOT {ends})"
    step = (
        f"CASE WHEN s.phase = 2 THEN s ELSE {{'t': '', "
        f"'depth': CASE WHEN {begins} OR {ends} THEN s.depth WHEN t.t IN {signs(C.OPEN)} THEN s.depth + 1 "
        f"WHEN t.t IN {signs(C.CLOSE)} THEN greatest(s.depth - 1, 0) ELSE s.depth END, "
        f"'phase': CASE WHEN {begins} THEN 1 WHEN {ends} THEN 2 ELSE s.phase END, "
        f"'cur': CASE WHEN {comma} OR {ends} OR {begins} THEN '' WHEN {here} THEN s.cur || t.t ELSE s.cur END, "
        f"'items': CASE WHEN {comma} OR {ends} THEN list_append(s.items, s.cur) ELSE s.items END}} END"
    )
    blank = "'depth': 0, 'phase': 0, 'cur': '', 'items': []::VARCHAR[]"
    tokens = f"list_transform(regexp_extract_all({after}, {_lit(C.TOKEN)}), lambda x: {{'t': x, {blank}}})"
    folded = f"list_reduce({tokens}, lambda s, t: {step}, {{'t': '', {blank}}})"
    params = f"(CASE WHEN {folded}.phase = 1 THEN list_append({folded}.items, {folded}.cur) ELSE {folded}.items END)"
    items = (
        f"list_filter(list_transform({params}, lambda x: regexp_replace(x, {_lit(C.TRIM)}, '', 'g')),"
        " lambda x: x <> '')"
    )
    if l == "rust":
        return f"len(list_filter({items}, lambda x: NOT regexp_matches(x, {_lit(C.RUST_SELF)}) AND instr(x, '...') = 0))"
    if l == "go":
        return (
            f"(CASE WHEN len(list_filter({items}, lambda x: instr(x, ' ') > 0)) > 0"
            f" THEN len(list_filter({items}, lambda x: instr(x, ' ') > 0 AND instr(x, '...') = 0))"
            f" ELSE len(list_filter({items}, lambda x: instr(x, '...') = 0)) END)"
        )
    if l == "julia":
        return f"len(list_filter({items}, lambda x: instr(x, '=') = 0 AND instr(x, '...') = 0))"
    return f"len(list_filter({items}, lambda x: instr(x, '...') = 0))"


def param_count(c: str, lang: str) -> str:
    arms = " ".join(
        f"WHEN '{l}' THEN (CASE WHEN {_has_header(c, l)} THEN {_items(l, c)} END)" for l in C.LANGS
    )
    return f"CAST((CASE {lang} {arms} END) AS INTEGER)"


def param_similarity(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {a} = {b} THEN 1.0"
        f" ELSE greatest(0.0, 1.0 - CAST(abs({a} - {b}) AS DOUBLE) * 0.2) END)"
    )


# ---------------------------------------------------- line folds (X1, X2, X5) --

X = C

_NL = "chr(10)"


def _clean(l: str) -> str:
    s = f"regexp_replace({l}, {_lit(X._STRING)}, '', 'g')"
    s = f"regexp_replace({s}, {_lit(X._CHAR)}, '', 'g')"
    return f"regexp_replace({s}, {_lit(X._LINE_COMMENT)}, '', 'g')"


def _cnt(s: str, ch: str) -> str:
    return f"CAST(length({s}) - length(replace({s}, '{ch}', '')) AS BIGINT)"


def _features(text: str, extra: dict[str, str]) -> str:
    c = _clean("l")
    fields = [
        "'line': l",
        "'pos': CAST(i - 1 AS BIGINT)",
        f"'delta': {_cnt(c, '{')} - {_cnt(c, '}')}",
        f"'opens': {_cnt(c, '{')}",
    ] + [f"'{k}': {v}" for k, v in extra.items()]
    return f"list_transform(string_split(coalesce({text}, ''), {_NL}), lambda l, i: {{{', '.join(fields)}}})"


_SEG_T = "STRUCT(depth BIGINT, pos BIGINT, stop BIGINT, attr BOOLEAN)"


def brace_segments(text: str, header: str, top_level_only: bool = False) -> str:
    bare = f"regexp_replace(l, {_lit(X._ATTRS_BEFORE)}, '')"
    feats = _features(
        text,
        {
            "hdr": f"regexp_matches({bare}, {_lit(header)})",
            "own_attr": f"contains(regexp_extract(l, {_lit(X._ATTRS_BEFORE)}), '#[test]')",
            "is_attr": "trim(l) = '#[test]'",
            "blank": "trim(l) = ''",
            "semi": f"regexp_matches({_clean('l')}, {_lit(X._SEMI_END)})",
        },
    )
    in_seg = f"(s.start > {X.NO_DEPTH})"
    is_header = "(it.hdr AND s.depth = 0)" if top_level_only else "it.hdr"
    starts = f"(NOT {in_seg} AND {is_header})"
    active = f"({in_seg} OR {starts})"
    new_depth = "(s.depth + it.delta)"
    opened = f"(({in_seg} AND s.opened) OR it.opens > 0)"
    seg_start = f"(CASE WHEN {in_seg} THEN s.start ELSE s.depth END)"
    closes = f"({active} AND {opened} AND {new_depth} <= {seg_start})"
    first = f"(CASE WHEN {starts} THEN it.pos ELSE s.first END)"
    seg_attr = f"(CASE WHEN {starts} THEN s.attr OR it.own_attr ELSE s.seg_attr END)"
    done = f"{{'depth': {seg_start}, 'pos': {first}, 'stop': it.pos, 'attr': {seg_attr}}}"
    keep_open = f"({active} AND NOT {closes} AND NOT (NOT {opened} AND it.semi))"
    step = (
        f"{{'depth': {new_depth}, 'start': CASE WHEN {keep_open} THEN {seg_start} ELSE CAST({X.NO_DEPTH} AS BIGINT) END, "
        f"'first': {first}, 'opened': {keep_open} AND {opened}, "
        f"'attr': NOT {active} AND (it.is_attr OR (it.blank AND s.attr)), "
        f"'seg_attr': {keep_open} AND {seg_attr}, "
        f"'segs': CASE WHEN {closes} THEN list_append(s.segs, {done}) ELSE s.segs END}}"
    )
    init = (
        f"{{'depth': CAST(0 AS BIGINT), 'start': CAST({X.NO_DEPTH} AS BIGINT), 'first': CAST(0 AS BIGINT), 'opened': false, 'attr': false, "
        f"'seg_attr': false, 'segs': []::{_SEG_T}[]}}"
    )
    lines = f"string_split(coalesce({text}, ''), {_NL})"
    head = f"ltrim(regexp_replace({lines}[g.pos + 1], {_lit(X._ATTRS_BEFORE)}, ''))"
    cut = f"array_to_string(list_concat([{head}], {lines}[g.pos + 2:g.stop + 1]), {_NL})"
    return (
        f"list_transform(list_reduce({feats}, lambda s, it: {step}, {init}).segs, "
        f"lambda g: {{'depth': g.depth, 'pos': g.pos, 'text': {cut}, 'attr': g.attr}})"
    )


def rust_tests(text: str) -> str:
    first = f"split_part(x.text, {_NL}, 1)"
    keep = (
        f"list_filter(list_sort({brace_segments(text, X.RUST_FN)}), "
        f"lambda x: x.attr OR instr({first}, 'test_') > 0 OR instr({first}, '_test') > 0)"
    )
    return f"list_transform({keep}, lambda x: {_lit(X.RUST_TEST_PREFIX.split(chr(10))[0])} || {_NL} || '    ' || x.text)"


def go_tests(text: str) -> str:
    t = f"coalesce({text}, '')"
    rest = f"(CASE WHEN instr({t}, 'func Test') > 0 THEN substring({t}, instr({t}, 'func Test') + 9) ELSE {t} END)"
    norm = f"(CASE WHEN length({rest}) = 0 THEN '' ELSE 'func Test' || upper(substring({rest}, 1, 1)) || substring({rest}, 2) END)"
    keep = (
        f"list_filter({brace_segments(norm, X.GO_FUNC, True)}, lambda x: instr(split_part(x.text, {_NL}, 1), 'Test') > 0 "
        "AND instr(x.text, '{') > 0 AND instr(x.text, '}') > 0)"
    )
    return f"(CASE WHEN length({norm}) = 0 THEN []::VARCHAR[] ELSE list_transform({keep}, lambda x: x.text) END)"


def clean_responses(lang: str, samples_sql: str) -> str:
    """SQL of ``operators.responses.clean_responses`` for rust or go."""
    fn = rust_tests if lang == "rust" else go_tests
    return f"""WITH s AS ({samples_sql}),
    r AS (SELECT conv_id, turn,
                 list_transform(response, lambda x: string_split(prompt, {_NL})[-1] || x) AS raw_response FROM s)
    SELECT conv_id, turn, raw_response,
           flatten(list_transform(raw_response, lambda r: {fn('r')}))[1:{X.MAX_TESTS}] AS response
    FROM r"""


def rust_imports(text: str) -> str:
    """SQL of ``functions.text.import_context`` for Rust."""
    feats = _features(
        text,
        {
            "code": r"regexp_replace(l, '\s+$', '', 'g')",
            "start": f"regexp_matches(l, {_lit(X._IMPORT_START['rust'])})",
            "mod_start": r"regexp_matches(l, '^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+\s*\{')",
            "end_line": "instr(l, ';') > 0",
        },
    )
    nd = "(s.depth + it.delta)"
    in_mod = "(s.mod_depth >= 0)"
    mod_start = f"(NOT {in_mod} AND it.mod_start)"
    mod_depth = (
        f"(CASE WHEN {in_mod} AND {nd} <= s.mod_depth THEN CAST(-1 AS BIGINT) WHEN {mod_start} THEN s.depth ELSE s.mod_depth END)"
    )
    cont = "(s.cur IS NOT NULL)"
    starts = f"(NOT {cont} AND NOT {in_mod} AND NOT {mod_start} AND it.start)"
    active = f"({cont} OR {starts})"
    text_now = f"(CASE WHEN {cont} THEN s.cur || {_NL} || it.code ELSE ltrim(it.code) END)"
    ends = "it.end_line"
    step = (
        f"{{'depth': {nd}, 'mod_depth': {mod_depth}, "
        f"'cur': CASE WHEN {active} AND NOT {ends} THEN {text_now} ELSE NULL::VARCHAR END, "
        f"'out': CASE WHEN {active} AND {ends} THEN list_append(s.out, {text_now}) ELSE s.out END}}"
    )
    init = "{'depth': CAST(0 AS BIGINT), 'mod_depth': CAST(-1 AS BIGINT), 'cur': NULL::VARCHAR, 'out': []::VARCHAR[]}"
    return f"array_to_string(list_reduce({feats}, lambda s, it: {step}, {init}).out, {_NL})"


def imports(text: str, lang: str) -> str:
    """SQL of ``functions.text.import_context`` for a lower-case language column."""
    no_str = lambda x: f"regexp_replace({x}, '\"[^\"]*\"', '', 'g')"
    feats = _features(
        text,
        {
            "code": r"regexp_replace(l, '\s+$', '', 'g')",
            "start": (
                f"(CASE WHEN {lang} = 'rust' THEN regexp_matches(l, {_lit(X._IMPORT_START['rust'])})"
                f" WHEN {lang} = 'go' THEN regexp_matches(l, {_lit(X._IMPORT_START['go'])})"
                f" WHEN {lang} = 'julia' THEN regexp_matches(l, {_lit(X._IMPORT_START['julia'])}) ELSE false END)"
            ),
            "go_top": f"({lang} = 'go')",
            "mod_start": f"({lang} = 'rust' AND regexp_matches(l, " + r"'^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+\s*\{'))",
            "end_line": (
                f"(CASE WHEN {lang} = 'rust' THEN instr(l, ';') > 0 WHEN {lang} = 'go' THEN instr({no_str('l')}, ')') > 0"
                r" ELSE NOT regexp_matches(l, ',\s*$') END)"
            ),
            "opens_paren": f"instr({no_str('l')}, '(') > 0",
        },
    )
    nd = "(s.depth + it.delta)"
    in_mod = "(s.mod_depth >= 0)"
    mod_start = f"(NOT {in_mod} AND it.mod_start)"
    mod_depth = (
        f"(CASE WHEN {in_mod} AND {nd} <= s.mod_depth THEN CAST(-1 AS BIGINT) WHEN {mod_start} THEN s.depth ELSE s.mod_depth END)"
    )
    cont = "(s.cur IS NOT NULL)"
    starts = f"(NOT {cont} AND NOT {in_mod} AND NOT {mod_start} AND it.start AND (NOT it.go_top OR s.depth = 0))"
    active = f"({cont} OR {starts})"
    text_now = f"(CASE WHEN {cont} THEN s.cur || {_NL} || it.code ELSE ltrim(it.code) END)"
    paren = f"(({cont} AND s.paren) OR ({starts} AND it.opens_paren))"
    ends = f"(CASE WHEN it.go_top THEN NOT {paren} OR it.end_line ELSE it.end_line END)"
    step = (
        f"{{'depth': {nd}, 'mod_depth': {mod_depth}, "
        f"'cur': CASE WHEN {active} AND NOT {ends} THEN {text_now} ELSE NULL::VARCHAR END, "
        f"'paren': {active} AND NOT {ends} AND {paren}, "
        f"'out': CASE WHEN {active} AND {ends} THEN list_append(s.out, {text_now}) ELSE s.out END}}"
    )
    init = "{'depth': CAST(0 AS BIGINT), 'mod_depth': CAST(-1 AS BIGINT), 'cur': NULL::VARCHAR, 'paren': false, 'out': []::VARCHAR[]}"
    return f"array_to_string(list_reduce({feats}, lambda s, it: {step}, {init}).out, {_NL})"


def strip_rust_tests(text: str) -> str:
    """SQL of ``functions.text.strip_rust_tests``."""
    drop = " OR ".join([f"trim(l) = {_lit(a)}" for a in X.TEST_ATTRS])
    drop = f"({drop} OR (starts_with(trim(l), '//') AND (instr(trim(l), 'test') > 0 OR instr(trim(l), 'assert') > 0)))"
    feats = _features(
        text,
        {
            "mod_hdr": f"regexp_matches(l, {_lit(X.RUST_TEST_MOD)})",
            "fn_hdr": f"regexp_matches(l, {_lit(X.RUST_FN)})",
            "semi": f"regexp_matches({_clean('l')}, {_lit(X._SEMI_END)})",
            "asserts": "instr(l, 'assert') > 0",
            "body_asserts": r"instr(regexp_extract(l, '\{(.*)$', 1), 'assert') > 0",
            "drop": drop,
        },
    )
    nd = "(s.depth + it.delta)"
    skipping = f"(s.skip > {X.NO_DEPTH})"
    in_fn = f"(s.fn_depth > {X.NO_DEPTH})"
    free = f"(NOT {skipping} AND NOT {in_fn})"
    mod_hdr = f"({free} AND it.mod_hdr)"
    fn_hdr = f"({free} AND NOT it.mod_hdr AND it.fn_hdr)"
    was_open = f"(({skipping} OR {in_fn}) AND s.opened)"
    opened = f"({was_open} OR it.opens > 0)"
    in_skip = f"({skipping} OR {mod_hdr})"
    skip_at = f"(CASE WHEN {skipping} THEN s.skip ELSE s.depth END)"
    skip_done = f"({in_skip} AND (({opened} AND {nd} <= {skip_at}) OR ({mod_hdr} AND it.opens = 0 AND it.semi)))"
    in_f = f"({in_fn} OR {fn_hdr})"
    fn_at = f"(CASE WHEN {in_fn} THEN s.fn_depth ELSE s.depth END)"
    buf = f"list_append(CASE WHEN {fn_hdr} THEN []::VARCHAR[] ELSE s.buf END, it.line)"
    here = f"(CASE WHEN {was_open} THEN it.asserts ELSE it.opens > 0 AND it.body_asserts END)"
    fn_assert = f"(({in_fn} AND s.fn_assert) OR {here})"
    fn_done = f"({in_f} AND {opened} AND {nd} <= {fn_at})"
    over = f"({fn_done} OR ({in_f} AND NOT {opened} AND it.semi))"
    out = (
        f"(CASE WHEN {in_skip} THEN s.out WHEN {in_f} THEN (CASE WHEN {over} AND NOT ({fn_done} AND {fn_assert}) "
        f"THEN list_concat(s.out, {buf}) ELSE s.out END) WHEN it.drop THEN s.out ELSE list_append(s.out, it.line) END)"
    )
    step = (
        f"{{'depth': {nd}, 'skip': CASE WHEN {in_skip} AND NOT {skip_done} THEN {skip_at} ELSE CAST({X.NO_DEPTH} AS BIGINT) END, "
        f"'fn_depth': CASE WHEN {in_f} AND NOT {over} THEN {fn_at} ELSE CAST({X.NO_DEPTH} AS BIGINT) END, "
        f"'opened': (({in_skip} AND NOT {skip_done}) OR ({in_f} AND NOT {over})) AND {opened}, "
        f"'fn_assert': {in_f} AND NOT {over} AND {fn_assert}, "
        f"'buf': CASE WHEN {in_f} AND NOT {over} THEN {buf} ELSE []::VARCHAR[] END, 'out': {out}}}"
    )
    init = (
        f"{{'depth': CAST(0 AS BIGINT), 'skip': CAST({X.NO_DEPTH} AS BIGINT), 'fn_depth': CAST({X.NO_DEPTH} AS BIGINT), 'opened': false, "
        "'fn_assert': false, 'buf': []::VARCHAR[], 'out': []::VARCHAR[]}"
    )
    # an unclosed function is kept: what is still held goes out at the end
    folded = f"list_reduce({feats}, lambda s, it: {step}, {init})"
    lines = f"array_to_string(list_concat({folded}.out, {folded}.buf), {_NL})"
    return f"regexp_replace({lines}, {_lit(X._TEST_COMMENTS)}, '\\1', 'g')"


# -------------------------------------------------------- lexer: a state table --

# language, state, rule order, what stands here, kind of these characters, whether they open a segment, next state, change of depth;
# a block comment goes on while its depth is above 0
_LEX_RULES = [
    *[(l, "code", 1, "^//", "line", True, "line", 0) for l in ("rust", "go", "java")],
    ("julia", "code", 1, "^#=", "block", True, "block", 1),
    ("julia", "code", 2, "^#", "line", True, "line", 0),
    *[(l, "code", 2, r"^/\*", "block", True, "block", 1) for l in ("rust", "go", "java")],
    ("rust", "code", 3, '^r#"', "raw", True, "raw", 0),
    ("java", "code", 3, '^"""', "raw", True, "raw", 0),
    *[(l, "code", 3, "^`", "tick", True, "tick", 0) for l in ("go", "julia")],
    *[(l, "code", 4, '^"', "string", True, "string", 0) for l in ("rust", "go", "julia", "java")],
    # a quote behind a name transposes in Julia: names are read whole
    ("julia", "code", 5, r"^[A-Za-z_]\w*'?", "code", False, "code", 0),
    *[(l, "code", 6, r"^'(\\.|[^'\\])'", "char", True, "code", 0) for l in ("rust", "go", "julia", "java")],
    *[(l, "line", 1, r"^\n", "code", False, "code", 0) for l in ("rust", "go", "julia", "java")],
    ("rust", "block", 1, r"^/\*", "block", False, "block", 1),
    ("julia", "block", 1, "^#=", "block", False, "block", 1),
    ("julia", "block", 2, "^=#", "block", False, "block", -1),
    *[(l, "block", 2, r"^\*/", "block", False, "block", -1) for l in ("rust", "go", "java")],
    *[(l, "string", 1, r"(?s)^\\.", "string", False, "string", 0) for l in ("rust", "julia")],
    *[(l, "string", 1, r"^\\.", "string", False, "string", 0) for l in ("go", "java")],
    *[(l, "string", 2, '^"', "string", False, "code", 0) for l in ("rust", "go", "julia", "java")],
    *[(l, "string", 3, r"^\n", "code", False, "code", 0) for l in ("go", "java")],
    ("rust", "raw", 1, '^"#', "raw", False, "code", 0),
    ("java", "raw", 1, r"(?s)^\\.", "raw", False, "raw", 0),
    ("java", "raw", 2, '^"""', "raw", False, "code", 0),
    ("julia", "tick", 1, r"(?s)^\\.", "tick", False, "tick", 0),
    *[(l, "tick", 2, "^`", "tick", False, "code", 0) for l in ("go", "julia")],
]


def lexed_segments(texts: str) -> str:
    """SQL of ``functions.lexer.lexed`` over (p_partkey, lang, code): one step of the state table a row, then segments."""
    rules = ", ".join(f"({_lit(l)}, {_lit(s)}, {o}, {_lit(p)}, {_lit(k)}, {opens}, {_lit(n)}, {d})" for l, s, o, p, k, opens, n, d in _LEX_RULES)
    return f"""WITH RECURSIVE rules(lang, state, ord, look, kind, opens, next, d) AS (VALUES {rules}),
    t AS ({texts}),
    run(p_partkey, lang, code, place, kind, opens, state, depth, taken) AS (
        SELECT p_partkey, lang, code, 1, 'code', false, 'code', 0, 0 FROM t
        UNION ALL
        SELECT p_partkey, lang, code, place + taken, m.kind, m.opens, CASE WHEN m.next = 'block' AND depth + m.d = 0 THEN 'code' ELSE m.next END, depth + m.d, m.n
        FROM (
            SELECT r.*, coalesce(
                (SELECT min_by({{'kind': u.kind, 'opens': u.opens, 'next': u.next, 'd': u.d,
                                 'n': length(regexp_extract(substring(r.code, r.place + r.taken, 80), u.look))}}, u.ord)
                 FROM rules u WHERE u.lang = r.lang AND u.state = r.state AND regexp_matches(substring(r.code, r.place + r.taken, 80), u.look)),
                {{'kind': r.state, 'opens': false, 'next': r.state, 'd': 0, 'n': 1}}) AS m
            FROM run r WHERE r.place + r.taken <= length(r.code))
    ),
    steps AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY place) AS segment FROM run WHERE taken > 0),
    segments AS (SELECT p_partkey, segment, any_value(kind) AS kind, min(place) - 1 AS start, max(place + taken) - 1 AS stop
                 FROM steps WHERE kind <> 'code' GROUP BY p_partkey, segment)
    SELECT t.p_partkey, t.lang, coalesce(string_agg(s.kind || ':' || s.start || ':' || s.stop, ',' ORDER BY s.start), '') AS segments
    FROM t LEFT JOIN segments s ON s.p_partkey = t.p_partkey GROUP BY t.p_partkey, t.lang"""


# ------------------------------------------------ C4: Ratcliff-Obershelp ratio --

_BEST = (
    "list_reduce(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: "
    "{'i': i, 'j': j, 'k': coalesce(list_min(list_filter(range(0, least(ahi - i, bhi - j)), "
    "lambda t: substr(a, i + t + 1, 1) <> substr(b, j + t + 1, 1))), least(ahi - i, bhi - j))}))), "
    "lambda acc, x: CASE WHEN x.k > acc.k THEN x ELSE acc END, {'i': alo, 'j': blo, 'k': CAST(0 AS BIGINT)})"
)


def name_ratio_ctes(pairs: str) -> str:
    """CTEs (to follow ``WITH RECURSIVE``) giving ``ratio_out(pid, name_score)``
    for ``pairs`` = a CTE name with columns (pid, a, b) (already lower-cased).

    Matching blocks as in the standard library for strings without junk: the
    longest common block of a range (earliest in a, then in b), then the same
    on the parts left and right of it; ratio = 2 * matched / total length."""
    return f"""rng(pid, a, b, alo, ahi, blo, bhi) AS (
        SELECT pid, a, b, CAST(0 AS BIGINT), CAST(length(a) AS BIGINT), CAST(0 AS BIGINT), CAST(length(b) AS BIGINT)
        FROM {pairs} WHERE length(a) > 0 AND length(b) > 0
        UNION ALL
        SELECT pid, a, b, u.c.alo, u.c.ahi, u.c.blo, u.c.bhi
        FROM (SELECT pid, a, b, alo, ahi, blo, bhi, {_BEST} AS m FROM rng) x,
             unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j}},
                     {{'alo': m.i + m.k, 'ahi': ahi, 'blo': m.j + m.k, 'bhi': bhi}}]) AS u(c)
        WHERE m.k > 0 AND u.c.alo < u.c.ahi AND u.c.blo < u.c.bhi),
    matched AS (SELECT pid, sum(({_BEST}).k) AS m FROM rng GROUP BY pid),
    ratio_out AS (SELECT p.pid, CASE WHEN length(p.a) = 0 OR length(p.b) = 0 THEN 0.0
                              ELSE CAST(2.0 AS DOUBLE) * coalesce(matched.m, 0) / (length(p.a) + length(p.b)) END AS name_score
                  FROM {pairs} p LEFT JOIN matched ON matched.pid = p.pid)"""


def hashed_embedding_md5(text: str, dim: int) -> str:
    """SQL of ``HashedEmbedder(dim, hash_fn="md5")``."""
    toks = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    buckets = f"list_transform({toks}, lambda t: CAST(('0x' || substring(md5(t), 1, 8)) AS BIGINT) % {dim})"
    counts = f"list_transform(range(0, {dim}), lambda i: CAST(len(list_filter({buckets}, lambda b: b = i)) AS DOUBLE))"
    return (
        f"list_transform({counts}, lambda c: CAST(c / (sqrt(list_sum(list_transform({counts}, lambda x: x * x))) + 1e-8) AS FLOAT))"
    )
