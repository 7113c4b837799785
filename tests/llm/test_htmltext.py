import html
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from exemplar.llm import htmltext, queries

from .common import SF

SCHEMA = "page_id long, url string, html string, text string, score double"


def run(spark, rows):
    return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)).collect()}


def text_of(page):
    return [t for t, z in htmltext.read_lines(page) if z != htmltext.FURNITURE]


def test_query_against_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op4_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        text = html.unescape(re.sub(r"</?(?:p|br|h1)[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert r.text == " ".join(text.split()) and r.n_chars == len(r.text)


def test_lines_and_zones():
    page = """<!DOCTYPE html><html><head><title>t &lt; u</title></head><body class="has-sidebar"><nav>menu</nav>
    <header>site</header><div class="cookie-notice">cookies</div><main><h1>A &amp; B</h1><p>one <b>tw</b>o&nbsp;three<br>four
    <p>five<!-- no --><script>if (a < b) x("</p>");</script><div class="ad">buy</div><form><input name=q>go</form>
    <section id="comments"><p>first!</section></main><aside>side</aside><div>loose</div><footer>&copy; me</footer>"""
    assert htmltext.read_lines(page) == [
        ("menu", 2), ("site", 2), ("cookies", 2), ("A & B", 1), ("one two three", 1), ("four", 1), ("five", 1),
        ("buy", 2), ("go", 2), ("first!", 2), ("side", 2), ("loose", 0), ("© me", 2),
    ]


def test_broken_markup():
    assert text_of("a < b <p>c<p>d</div>e<!-- open") == ["a < b", "c", "d", "e"]
    assert text_of("<article>x<script>never closed") == ["x"]
    assert text_of("<p>1 &am") == ["1 &am"]
    assert text_of('<p>one <span class="ad">buy</span> two <a href="x">three</a></p>') == ["one", "two three"]
    assert text_of("plain") == ["plain"] and text_of("") == text_of(None) == []


def test_shared_lines_go_and_copied_articles_stay(spark):
    frame = "<div>Welcome to the site</div><div>Read more below</div>{}<div>Call us today</div>"
    rows = [(i, f"http://h.example/a/{i}?x=1", frame.format(f"<div>Only on page {i}</div>")) for i in range(6)]
    rows += [(10 + i, f"http://copies.example/{i}", "<nav>menu</nav><article><p>The same article</article>") for i in range(4)]
    rows += [(20, "http://alone.example/", "<div>kept line</div><nav>menu</nav>"), (21, None, "<p>no url</p>"), (22, "odd url", None), (23, "http://h2.example", "")]
    rows += [(30, "http://twice.example/", "<div>same</div>")] * 2
    got = run(spark, rows)
    assert [got[i] for i in range(6)] == [f"Only on page {i}" for i in range(6)]
    assert [got[10 + i] for i in range(4)] == ["The same article"] * 4
    assert (got[20], got[21], got[22], got[23], got[30]) == ("kept line", "no url", "", "", "same")


def test_neighbours_across_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [(i, f"http://h.example/{i:03}", f"<div>Shared</div><div>own {i}</div>") for i in range(14)]
        assert run(spark, rows) == {i: f"own {i}" for i in range(14)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_long_page_and_empty_table(spark):
    page = "<article>" + "".join(f"<p>line {i % 700}</p>" for i in range(20_000)) + "</article>"
    got = run(spark, [(1, "http://h/1", page), (2, "http://h/2", page.replace("line 5<", "other<"))])
    assert got[1] == " ".join(f"line {i % 700}" for i in range(20_000)) and got[2].count("other") == got[1].split("line ").count("5 ")
    assert run(spark, []) == {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=10), st.lists(st.integers(0, 4), max_size=10), st.booleans())
def test_longest_common_subsequence(a, b, halve):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    marks = htmltext.common_lines(np.array(a, np.int64), np.array(b, np.int64))
    rest = iter(b)
    assert marks.sum() == table[-1][-1] and all(x in rest for x in np.array(a, np.int64)[marks].tolist())
    if halve:
        assert htmltext._lengths(a, b).tolist() == table[-1] if a else True


def test_copies_outside_articles_keep_their_text(spark):
    long = "<div>" + "a long text that copies share. " * 20 + "</div>"
    text = ("a long text that copies share. " * 20).strip()
    frame = "<div>Welcome to the site</div>{}"
    rows = [(1, "http://one.example/a", long), (2, "http://one.example/b", long)]  # a host of copies only
    rows += [(3, "http://page.example/l?page=1", long + "<div>p. 1</div>"), (4, "http://page.example/l?page=2", long + "<div>p. 2</div>")]
    rows += [(10 + i, f"http://mix.example/{i}", frame.format(long)) for i in range(5)]
    rows += [(15 + i, f"http://mix.example/{5 + i}", frame.format(f"<div>{'Another text altogether, not copied. ' * 9}</div>")) for i in range(5)]
    rows += [(30, "http://twice.example/", "<div>same</div>")] * 2  # repeated rows
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for partitions in ("1", "4", "13"):  # classes within, at and across partition borders
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = run(spark, rows)
            assert got[1] == got[2] == text and (got[3], got[4]) == (text + " p. 1", text + " p. 2") and got[30] == "same"
            assert {got[10 + i] for i in range(5)} == {text}
            assert {got[15 + i] for i in range(5)} == {("Another text altogether, not copied. " * 9).strip()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_page_wrappers_do_not_swallow_the_article():
    for wrapper in ("class='layout has-sidebar'", "id='page' class='no-banner'", "class='social-policy'", "class='sidebar'", "id=banner", "class=widget"):
        page = f"<body><div {wrapper}><nav>menu</nav><article class='has-comments'><p>text</article></div>"
        assert htmltext.read_lines(page) == [("menu", 2), ("text", 1)], wrapper
    assert text_of("<section class='social-policy'><p>On social policy</section><div class='nav-open'>shown</div>") == ["On social policy", "shown"]
    for name in ("site-footer", "main_nav", "cookie-notice", "sidebar-left", "ad-slot-3", "footer-legal", "post-comments", "share-buttons", "ad"):
        assert text_of(f"<div class='x {name}'>furniture</div>text") == ["text"], name
    # readers' comments stay furniture; a list of other articles is the content only of a page without its own
    assert text_of("<article>own</article><div id=comments><article>first!</article></div><article class='comment'>2nd</article>") == ["own"]
    other = "<div class='related-posts'><article>other</article></div>"
    assert text_of("<main>own" + other + "</main>") == ["own"] and text_of(other) == ["other"]
    assert text_of("<div class=related><main>own</main></div>") == ["own"]


def test_unclosed_raw_elements_end_with_their_parent():
    for tag in ("button", "select", "svg", "object", "video", "textarea", "noscript"):
        assert text_of(f"<article><p>one <{tag}>raw</p><p>two</p></article>") == ["one", "two"], tag
        assert text_of(f"<article><p>one<div><{tag}>raw</div>two</article><p>three") == ["one", "two", "three"], tag
        assert text_of(f"<article><{tag}>raw<p>one</article><div>two</div>") == ["one", "two"], tag
    for tag in ("button", "svg", "object", "video"):  # the end tag of another element
        assert text_of(f"<article><p><{tag}>raw<p>one</article><footer><{tag}>x</{tag}></footer><p>two") == ["one", "two"], tag
    assert text_of("<p>a<object><object>x</object>y</object>b<svg/>c<style>never closed <p>d") == ["a", "b", "c"]
