"""Property tests: test extraction, stripping and imports (X1, X2, X5, X6), which read the nesting
tree, against plain-Python folds over lines on random texts made of whole-line constructs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from exemplar.functions import text as X
from exemplar.plans import patterns as P

LINES = [
    "fn test_a() {", "fn helper() {", "pub fn b_test(x: i32) {", "#[test]", "}", "    let x = 1;", "mod tests {", "",
    "fn one() {}", '    let s = "{";', "// comment {", "    fn inner_test() {", "    }", "#[should_panic]", "impl S {",
    "    let c = '}';", "fn test_two() { x(); }",
]


def _segments(text, header):
    depth, start, opened, attr, seg_attr, cur, segs = 0, P.NO_DEPTH, False, False, False, [], []
    for pos, line in enumerate(text.split("\n")):
        clean = re.sub(P._LINE_COMMENT, "", re.sub(P._CHAR, "", re.sub(P._STRING, "", line)), flags=re.ASCII)
        opens = clean.count("{")
        delta = opens - clean.count("}")
        in_seg = start > P.NO_DEPTH
        starts = not in_seg and re.search(header, line, flags=re.ASCII) is not None
        active = in_seg or starts
        new_depth = depth + delta
        now_opened = (in_seg and opened) or opens > 0
        seg_start = start if in_seg else depth
        closes = active and now_opened and new_depth <= seg_start
        if active:
            cur = ([line.lstrip(" ")] if starts else cur + [line])
        sattr = attr if starts else seg_attr
        if closes:
            segs.append((seg_start, pos - len(cur) + 1, "\n".join(cur), sattr))
        keep = active and not closes
        attr = (not active) and (line.strip(" ") == "#[test]" or (line.strip(" ") == "" and attr))
        depth, start, opened, seg_attr = new_depth, seg_start if keep else P.NO_DEPTH, keep and now_opened, keep and sattr
        cur = cur if keep else []
    return segs


def _rust_tests(text):
    out = []
    for d, p, t, a in sorted(_segments(text, P.RUST_FN)):
        first = t.split("\n")[0]
        if a or "test_" in first or "_test" in first:
            out.append(X.RUST_TEST_PREFIX + t)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LINES), min_size=0, max_size=14), min_size=1, max_size=12))
def test_rust_fold_matches_python(spark, docs):
    texts = ["\n".join(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.rust_tests(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _rust_tests(t), t


STRIP_LINES = LINES + ["#[cfg(test)]", "mod tests;", "mod test_utils {", "    assert!(ok);", "// test helper", "use a::b;"]


def _strip(text):
    depth, skip, fn_depth, opened, fn_assert, buf, out = 0, P.NO_DEPTH, P.NO_DEPTH, False, False, [], []
    for line in text.split("\n"):
        clean = re.sub(P._LINE_COMMENT, "", re.sub(P._CHAR, "", re.sub(P._STRING, "", line)), flags=re.ASCII)
        opens = clean.count("{")
        nd = depth + opens - clean.count("}")
        skipping, in_fn = skip > P.NO_DEPTH, fn_depth > P.NO_DEPTH
        free = not skipping and not in_fn
        is_mod = re.search(P.RUST_TEST_MOD, line, flags=re.ASCII) is not None
        mod_hdr = free and is_mod
        fn_hdr = free and not is_mod and re.search(P.RUST_FN, line, flags=re.ASCII) is not None
        now_opened = ((skipping or in_fn) and opened) or opens > 0
        in_skip = skipping or mod_hdr
        skip_at = skip if skipping else depth
        bare_end = clean.rstrip().endswith(";")
        skip_done = in_skip and ((now_opened and nd <= skip_at) or (mod_hdr and opens == 0 and bare_end))
        in_f = in_fn or fn_hdr
        fn_at = fn_depth if in_fn else depth
        nbuf = ([] if fn_hdr else buf) + [line]
        was_open = in_fn and opened
        body = line if was_open else line.partition("{")[2] if opens else ""
        nfa = (in_fn and fn_assert) or "assert" in body
        fn_done = in_f and now_opened and nd <= fn_at
        over = fn_done or (in_f and not now_opened and bare_end)
        t = line.strip(" ")
        drop = t in X.TEST_ATTRS or (t.startswith("//") and ("test" in t or "assert" in t))
        if in_skip:
            pass
        elif in_f:
            if over and not (fn_done and nfa):
                out += nbuf
        elif not drop:
            out.append(line)
        depth = nd
        skip = skip_at if in_skip and not skip_done else P.NO_DEPTH
        fn_depth = fn_at if in_f and not over else P.NO_DEPTH
        opened = ((in_skip and not skip_done) or (in_f and not over)) and now_opened
        fn_assert = in_f and not over and nfa
        buf = nbuf if in_f and not over else []
    # an unclosed function is kept; what is left of comments that mention tests goes
    return re.sub(r"//[^\n]*(?:test|assert)[^\n]*", "", "\n".join(out + buf))


# hand-written: what is left of a file after its tests are taken out
STRIPPED = [
    ("trait T {\n fn a(&self);\n}\nstruct X;\nconst N: i32 = 1;", "trait T {\n fn a(&self);\n}\nstruct X;\nconst N: i32 = 1;"),
    ("fn assert_close(a: f64) {\n  x();\n}\nfn t() { assert!(1); }\nlast", "fn assert_close(a: f64) {\n  x();\n}\nlast"),
    ("fn a() {\n  y(); // test me\n  let s = \"// test\";\n}\n/* assert */z;", "fn a() {\n  y(); \n  let s = \"// test\";\n}\nz;"),
    ("// don't \"\nq; /* multi\n test */w\n// plain", "// don't \"\nq; w\n// plain"),
    ("fn open(\n a: [u8; 4],\n) {\n go(x)", "fn open(\n a: [u8; 4],\n) {\n go(x)"),
    ("mod tests {\n fn a() {}\n}\n#[cfg(test)]\nmod my_test;\nfn b() {}", "fn b() {}"),
]

TESTS = [
    ("trait T { fn a(&self); }\n#[test]\nfn real() { x(); }", ["fn real() { x(); }"]),
    ("trait T {\n fn a(&self);\n}\n#[test]\n\nfn real(\n) {\n x();\n}", ["fn real(\n) {\n x();\n}"]),
    ("#[test] fn real() { x(); }", ["fn real() { x(); }"]),
    ("#[test]\n#[ignore]\nfn skipped() {}\nfn a_test() {}", ["fn a_test() {}"]),
]


def test_expected_files_and_tests(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STRIPPED)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.strip_rust_tests(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(STRIPPED))] == [e for _, e in STRIPPED]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TESTS)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.rust_tests(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(TESTS))] == [[X.RUST_TEST_PREFIX + t for t in e] for _, e in TESTS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(STRIP_LINES), min_size=0, max_size=14), min_size=1, max_size=12))
def test_strip_fold_matches_python(spark, docs):
    texts = ["\n".join(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.strip_rust_tests(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _strip(t), t


# whole constructs: on broken texts a fold over lines and a tree need not agree
GO_PARTS = ["func TestA(t *testing.T) {\n  x := 1\n}", "func helper() {\n  if x { y() }\n}", "func (s *S) TestM() {\n}",
            'func TestB(t *testing.T) { t.Log("}") }', "", "// plain {", "prose before", "var x = 1"]


def _go_tests(text):
    rest = text.split("func Test", 1)[-1]
    if not rest:
        return []
    norm = "func Test" + rest[0].upper() + rest[1:]
    out = []
    for d, p, t, a in _segments_top(norm, P.GO_FUNC + r"\s*[\[(]"):
        first = t.split("\n")[0]
        if "Test" in first and "{" in t and "}" in t:
            out.append(t)
    return out


def _segments_top(text, header):
    # _segments with headers only at depth 0
    depth, start, opened, cur, segs = 0, P.NO_DEPTH, False, [], []
    for pos, line in enumerate(text.split("\n")):
        clean = re.sub(P._LINE_COMMENT, "", re.sub(P._CHAR, "", re.sub(P._STRING, "", line)), flags=re.ASCII)
        opens = clean.count("{")
        new_depth = depth + opens - clean.count("}")
        in_seg = start > P.NO_DEPTH
        starts = not in_seg and depth == 0 and re.search(header, line, flags=re.ASCII) is not None
        active = in_seg or starts
        now_opened = (in_seg and opened) or opens > 0
        seg_start = start if in_seg else depth
        closes = active and now_opened and new_depth <= seg_start
        if active:
            cur = [line.lstrip(" ")] if starts else cur + [line]
        if closes:
            segs.append((seg_start, pos - len(cur) + 1, "\n".join(cur), False))
        keep = active and not closes
        depth, start, opened = new_depth, seg_start if keep else P.NO_DEPTH, keep and now_opened
        cur = cur if keep else []
    return segs


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(GO_PARTS), min_size=0, max_size=12), min_size=1, max_size=12))
def test_go_fold_matches_python(spark, docs):
    texts = ["\n".join(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.go_tests(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _go_tests(t), t


IMPORT_PARTS = {
    "rust": ["use a::b;", "use c::{\n    d,\n};", "mod tests {\n    use super::*;\n}", "fn f() {\n    use g::h;\n}", "// use x;", "pub use e::f;", ""],
    "go": ["package p", 'import "fmt"', 'import (\n    "os"\n)', 'func f() {\n    x := g(")")\n}', ""],
    "julia": ["using Test", "import A: b,\n    c", "x = 1", "# import Y", "  using B", ""],
}


def _imports(lang, text):
    starts = {"rust": P._IMPORT_START["rust"], "go": P._IMPORT_START["go"], "julia": P._IMPORT_START["julia"]}
    depth, mod_depth, cur, paren, out = 0, P.NO_DEPTH, None, False, []
    for line in text.split("\n"):
        clean = re.sub(P._LINE_COMMENT, "", re.sub(P._CHAR, "", re.sub(P._STRING, "", line)), flags=re.ASCII)
        nd = depth + clean.count("{") - clean.count("}")
        code = re.sub(r"\s+$", "", line, flags=re.ASCII)
        no_str = re.sub(r'"[^"]*"', "", line)
        in_mod = mod_depth > P.NO_DEPTH
        mod_start = lang == "rust" and not in_mod and cur is None and re.search(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+\s*\{", line, flags=re.ASCII) is not None
        new_mod = P.NO_DEPTH if (in_mod and nd <= mod_depth) else (depth if mod_start else mod_depth)
        cont = cur is not None
        st_ = re.search(starts[lang], line, flags=re.ASCII) is not None
        go_top = lang == "go"
        starts_now = not cont and not in_mod and not mod_start and st_ and (not go_top or depth == 0)
        active = cont or starts_now
        text_now = (cur + "\n" + code) if cont else code.lstrip(" ")
        p = (cont and paren) or (starts_now and "(" in no_str)
        if lang == "rust":
            end_line = ";" in clean
        elif lang == "go":
            end_line = ")" in no_str
        else:
            end_line = re.search(r",\s*$", line, flags=re.ASCII) is None
        ends = (not p or end_line) if go_top else end_line
        if active and ends:
            out.append(text_now)
        cur = text_now if active and not ends else None
        paren = active and not ends and p
        depth, mod_depth = nd, new_mod
    return "\n".join(out)


@settings(max_examples=10, deadline=None)
@given(st.sampled_from(["rust", "go", "julia"]), st.data())
def test_import_fold_matches_python(spark, lang, data):
    docs = data.draw(st.lists(st.lists(st.sampled_from(IMPORT_PARTS[lang]), max_size=12), min_size=1, max_size=10))
    texts = ["\n".join(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.import_context(F.lit(lang), F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _imports(lang, t), (lang, t)
