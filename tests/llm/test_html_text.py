import random
import time

from pyspark.sql import types as T

from tablechange.llm.html_text import extract_text, html_to_text
from tablechange.llm.queries import QUERIES

CASES = {
    "": "",
    "plain   text\n here": "plain text here",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>": "a\nb",
    "a <b>bold</b>, <i>x</i>y": "a bold, xy",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>": "- one\n- two\n  3. x\n  4. y",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><caption>t</caption><tr><th>h</th></tr><tr><td><p>x</p><p>y</p></td><td>z</td></tr></table>": "t\nh\nx  z\n\ny",
    "<p>see<p hidden>no</p><p style='display: none'>no</p><span style=\"visibility:hidden\">no</span><!-- no --><script>no()</script><style>no</style>": "see",
    "<head><title>no</title></head><body>yes</body>": "yes",
    "<title>no<p>yes": "",
    "&lt;b&gt; &amp; &eacute;": "<b> & é",
    "<pre>  a\n   b</pre>after": "  a\n   b\n\nafter",
    "x </nothing> y </p> z": "x y z",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<a href='x\">open</a> <b>t": "open t",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<select><option>no</select>yes<!doctype x><?php no ?>": "yes",
    "a<nav>b<ul><li>c</ul></nav><footer>d</footer>": "a\nb\n\n- c\n\nd",
    "<script>if (a < b) '</p>'</script>x": "x",
    "<td>lonely": "lonely",
}


def test_cases():
    for html, text in CASES.items():
        assert html_to_text(html) == text, html
    assert html_to_text(None) == ""


SHOWN = {
    "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds": "so x=2 holds",
    "<math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>": "y",
    "a<svg>no<title>no</title><desc>no</desc><defs><text>no</text></defs><g><text x=1>one <tspan>two</tspan></text><text>three</text></g></svg>b": "a\none two\nthree\nb",
    "<svg><foreignObject><p>in</p></foreignObject></svg>": "in",
    "a <desc>b</desc> <text>c</text>": "a b c",
    "<p>n<textarea>\n a &amp; <b>\n  c</textarea>m": "n\n a & <b>\n  c\nm",
    "<textarea></textarea>x": "x",
    "<head><title>t</title>Hello<p>x": "Hello\n\nx",
    "<head> \n<title>t</title> <meta charset=x>\n&amp; more</head><body>y": "& more\ny",
}


def test_shown():
    for html, text in SHOWN.items():
        assert html_to_text(html) == text, html


LAID_OUT = {
    "<table><tr><td rowspan=2>R<td>1<tr><td>2</table>": "R  1\n   2",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>": "wide cell  x\na  b       c",
    "<table><tr><td colspan=9>over all<tr><td>a<td>b</table>": "over all\na  b",
    "<table><tr><td>a<td rowspan=0>b<br>c<br>d<tr><td>e</table>": "a  b\ne  c\n   d",
    "<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>d</table><td>e</table>": "a  b  c  e\n   d",
    "<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>d<td>e<td>f</table>": "a     c\nd  e  f",
    "<table><tr><td>a<td style='display:none'>b<td>c<tr><td>d<td>e</table>": "a  c\nd  e",
    "<table><tr><td>a<tr style='visibility:collapse'><td>b<tr><td>c</table>": "a\nc",
    "<table><form><tr><td>a<td>b</form><tr><td>c<td>d</table>": "a  b\nc  d",
    "<table><tr><td>a</table><p>b": "a\n\nb",
    "x<span style='visibility: hidden'>no <b style='visibility: visible'>yes</b> no</span>": "xyes",
    "<p style='backface-visibility:hidden'>yes<p style='display:none;display:block'>shown<p style='display:none!important;display:block'>no": "yes\n\nshown",
    "<select><option selected>Germany</option><option>France</select>after": "Germany after",
    "in <select><optgroup><option>a<option selected> b  c</optgroup></select>, then": "in b c , then",
    "<select multiple><option>a<option>b</select>c": "a\nb\nc",
    "<select size=3><option>a<option hidden>no<option>b</select>c": "a\nb\nc",
}


def test_laid_out():
    for html, text in LAID_OUT.items():
        assert html_to_text(html) == text, html


def test_tables_against_random_tilings():
    """Tables are cut into rectangles first and written as HTML then, so that where each cell stands is known without
    any table algorithm: cells of a column start at one offset, cells of a row on one line, and nothing overlaps."""
    rng = random.Random(4)
    for _ in range(300):
        rows, cols = rng.randrange(1, 6), rng.randrange(1, 6)
        owner, cells = {}, []
        for y in range(rows):
            for x in range(cols):
                if (y, x) in owner:
                    continue
                w = 1
                while x + w < cols and (y, x + w) not in owner and rng.random() < 0.3:
                    w += 1
                h = 1
                while y + h < rows and rng.random() < 0.3:
                    h += 1
                cells.append((y, x, h, w, f"<{len(cells)}" + "abcdefghij"[: rng.randrange(10)] + ">"))
                owner |= {(i, j): cells[-1] for i in range(y, y + h) for j in range(x, x + w)}
        escaped = [c[4].replace("<", "&lt;").replace(">", "&gt;") for c in cells]
        html = "<table>"
        for y in range(rows):
            html += "<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for (r, _, h, w, _), t in zip(cells, escaped) if r == y)
        lines = html_to_text(html + "</table>").split("\n")
        at = {}
        for c in cells:
            found = [(i, line.index(c[4])) for i, line in enumerate(lines) if c[4] in line]
            assert len(found) == 1, html
            at[c] = found[0]
        for a in cells:
            for b in cells:
                assert (at[a][0] < at[b][0]) == (a[0] < b[0]) and (at[a][1] < at[b][1]) == (a[1] < b[1]), html
                if at[a][0] == at[b][0] and a[1] < b[1]:
                    assert at[a][1] + len(a[4]) + 2 <= at[b][1], html
        assert sum(len(line.replace(" ", "")) for line in lines) == sum(len(c[4]) for c in cells)


def test_time_goes_with_length():
    began = time.perf_counter()
    for html in ("<b>" * 40_000 + "</i>" * 40_000, "<table><tr><td>" + "<i>" * 40_000 + "</b>" * 40_000, "<b><hr>" * 40_000, "<b><body>" * 20_000, "<b><td>" * 20_000):
        assert html_to_text(html + "x") == "x"
    assert time.perf_counter() - began < 20
    deep = "".join(f"<table><tr><td>{i}<td>" for i in range(300)) + "in"
    assert html_to_text(deep).split() == [*map(str, range(300)), "in"]


def test_deep_and_long():
    assert html_to_text("<div>" * 20_000 + "x") == "x"
    deep = "<table><tr><td>" * 200 + "in"
    assert html_to_text(deep) == "in"
    assert html_to_text("<p>w" * 50_000).count("w") == 50_000
    assert html_to_text("<" * 20_000).count("<") == 20_000


def test_every_visible_word_stays(spark, sf):
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", r["html"])
        want = re.sub(r"<[^>]*>", " ", body).replace("&copy;", "©").replace("&middot;", "·").replace("&amp;", "&").split()
        assert [w for w in html_to_text(r["html"]).split() if w != "-"] == [w for w in want if w != "-"]


def test_operator(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, "<p>a", "clash"), (1, "<p>a", None), (None, None, None), (2, "", "")]
    got = sorted(map(tuple, extract_text(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "a"), (None, ""), (2, "")], key=repr)
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op10_html_text"](spark, sf).collect()}
    assert got == {i: html_to_text(h) for i, h in pages.items()}
