"""HTML extraction: layout by example, visible words against a plain event scan."""

import random
from html.parser import HTMLParser

import pytest
from tenantscope.llm.html_text import HIDDEN, MAX_DEPTH, extract_text, op8_html_extraction, page_text, parse

CASES = [
    ("<p>One<p>Two</p> tail", "One\n\nTwo\n\ntail"),
    ("<div>a</div><div>b<div>c</div></div>", "a\nb\nc"),
    ("a <b>bold</b><i> it</i>alic  \n x", "a bold italic x"),
    ("<h1>T</h1>text<br>next<br><br>gap", "T\n\ntext\nnext\n\ngap"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a</li><li><p>b</p><p>c</p></li></ol>", "3. a\n\n4. b\n\n   c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>", "Name   Qty\napple  3\nfig    12"),
    ("<table><caption>C</caption><tbody><tr><td colspan=2>wide cell<tr><td>a</td><td>b<br>c</td></tr></table>z", "C\nwide cell\na  b\n   c\n\nz"),
    ("<pre>\n a  b\n\tc</pre>d", " a  b\n\tc\n\nd"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("x<script>if (a<b) '</p>'</script><style>p{}</style><!-- c --><noscript>n</noscript>y", "xy"),
    ("<p hidden>h</p><p style='display: none'>n<p>v</p><div style=\"visibility:hidden\"><b>q</b></div><input type=hidden value=z>w", "v\n\nw"),
    ("<title>T</title><body>&lt;b&gt; &amp;amp; &eacute;&#233; &nbsp;x", "<b> &amp; éé  x"),
    ("a<b<c d='>'>e</b>", "ae"), ("1 < 2 and <3 </ p>x", "1 < 2 and <3 x"), ("<a href=\"x>y\">in</a> <img alt='q'> out", "in out"),
    ("text <unfinished", "text"), ("<![CDATA[raw]]> <?php x ?>z<!doctype html>", "raw z"),
    ("<b><p>x</b>y</p>", "xy"), ("</p></div>a</table>b", "ab"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<select><option>a<option>b</select><textarea>\n l1\n l2</textarea>", "a\nb\n l1\n l2"),
    ("<blockquote>q<p>r</p></blockquote>s", "  q\n\n  r\n\ns"), ("", ""), (None, ""), ("  \n ", ""), ("plain", "plain"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_layout(source, text):
    assert page_text(source) == text


@pytest.mark.parametrize(("source", "text"), [
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><semantics><mi>y</mi><annotation>TeX</annotation></semantics></math> b", "a x= 1 2 y b"),
    ("<svg><title>T</title><desc>D</desc><defs><text>no</text></defs><metadata>m</metadata><style>s{}</style><path d='M0'/>"
     "<text>one</text><text x=1>two <tspan>three</tspan></text></svg>x", "one two three x"),
    ("<desc>d</desc><defs>e</defs><text>f</text>", "def"),
    *((f"<input type={t} value='v 1'>", "v 1") for t in ("email", "URL", "tel", "number", "search", "date", "text", "submit", "made-up")),
    ("<input value=v>", "v"),
    *((f"<input type={t} value=v>w", "w") for t in ("hidden", "password", "checkbox", "radio", "file", "color", "range")),
])
def test_formulas_drawings_and_inputs(source, text):
    assert page_text(source) == text


@pytest.mark.parametrize("depth", [3, 511, 512, 513, 900])
def test_what_is_hidden_stays_so_at_any_depth(depth):
    inner = "a<script>s</script><p hidden>h<b>i</b></p><div style='display:none'><div>j</div>k</div><div>b</div>c<svg><defs><text>n</text></defs></svg>"
    assert page_text("<div>" * depth + inner + "</div>" * depth + "z").split() == ["a", "b", "c", "z"]


class Words(HTMLParser):
    """Visible words, in order, by plain events (well-formed pages only)."""

    def __init__(self):
        super().__init__()
        self.off, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img", "input"):
            a = dict(attrs)
            self.off.append(tag in HIDDEN or "hidden" in a or "none" in (a.get("style") or ""))

    def handle_endtag(self, tag):
        if tag not in ("br", "hr", "img", "input"):
            self.off.pop()

    def handle_data(self, data):
        if not any(self.off):
            self.words += data.split()


def page(rnd, depth=0):
    if depth > 4 or rnd.random() < 0.3:
        return " " + " ".join(rnd.choice(["alpha", "b&amp;c", "été", "x1", "&lt;tag&gt;"]) for _ in range(rnd.randrange(1, 5))) + " "
    tag = rnd.choice(["div", "section", "ul", "blockquote", "span", "b", "div hidden", "script", "table", "p", "article", "div style='display:none'"])
    name = tag.split()[0]
    if name == "script":
        return "<script>var a = 1;</script>"
    if name == "p":
        return "<p>para " + rnd.choice(["<b>x</b>", "y<br>z", ""]) + "</p>"
    kids = [page(rnd, depth + 1) for _ in range(rnd.randrange(1, 4))]
    if name == "ul":
        return "<ul>" + "".join(f"<li>{k}</li>" for k in kids) + "</ul>"
    if name == "table":
        return "<table><tr>" + "".join(f"<td>{k}</td>" for k in kids[:1]) + "</tr></table>"
    if name in ("span", "b"):
        return f"<{tag}> plain </{name}>"
    return f"<{tag}>{''.join(kids)}</{name}>"


@pytest.mark.parametrize("seed", range(60))
def test_visible_words(seed):
    source = page(random.Random(seed))
    w = Words()
    w.feed(source)
    got = [x for line in page_text(source).split("\n") for x in line.removeprefix(line[:len(line) - len(line.lstrip())]).removeprefix("- ").split()]
    assert [x for x in got if x != "-"] == w.words


def test_deep_and_long_pages():
    n = 20000
    assert page_text("<div>" * n + "x" + "</div>" * n + "y").split() == ["x", "y"]
    assert page_text("<table><tr><td>" * 300 + "x").strip() == "x"
    assert page_text("<ul><li>" * 600 + "x").split()[-1] == "x"
    assert len(page_text("<p>word</p>" * 100_000)) == 6 * 100_000 - 2
    assert page_text("<a " * 3000 + "<p>x") in ("", "x")
    root, depth = parse("<div>" * n), 0
    while root.children:
        root, depth = root.children[-1], depth + 1
    assert depth <= MAX_DEPTH


def test_query_and_odd_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in op8_html_extraction(pages).collect()}
    for r in pages.collect():
        text = page_text(r.html)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (text, len(text))
        assert got[r.page_id].n_lines == (len(text.split("\n")) if text else 0)
    odd = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>a", None)], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in extract_text(odd).collect()) == [("1", ""), ("1", ""), ("None", "a")]
    assert not op8_html_extraction(pages.limit(0)).collect()
