import time

from larkspur.llm.html_extract import extract_text, html_extract

CASES = [
    (None, ""), ("", ""), ("plain &amp; bare", "plain & bare"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("a<br>b", "a\nb"), ("a <b> b </b> c", "a b c"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>V<tr><td>x<td>long one</table>", "Name | V\nx    | long one"), ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab |   | c\n1  | 2 | 3"),
    ("<head><title>t</title></head><body>x<script>if (a<b) '</p>'</script><style>p{}</style><!-- no --><p hidden>no<p style='display: none'>no<p>yes", "x\n\nyes"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("<p>a</div>b", "ab"), ("<a title='x > y'>t</a>", "t"), ('<a title="open>t</a> u', "t u"), ("a<!-- never closed", "a"), ("<input type=hidden value=n><input value=v>", "v"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("<img alt='pic'> x", "pic x"), ("&copy;&#65;&nosuch;", "©A&nosuch;"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a in | b"),
]


def test_cases():
    for html, want in CASES:
        assert extract_text(html) == want, html


def test_deep_and_long_pages():
    assert extract_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert extract_text("<b>" * 5_000 + "y") == "y"
    assert len(extract_text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    assert extract_text("<" * 3000) == "<" * 3000


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>x", "u"), (1, "<p>x", "u"), (None, None, "u")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_extract(pages).collect()), key=repr) == [(1, "x", 1), (1, "x", 1), (None, "", 0)]
    assert html_extract(pages.limit(0)).count() == 0


FOREIGN = [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"), ("<math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation></semantics></math>", "y"),
    ("<math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>", "a b"), ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>", "1 2\n3 4"),
    ("x<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><style>no{}</style><text>one</text><rect/><text>t<tspan>wo</tspan></text></svg>y", "x\none\ntwo\ny"),
    ("<svg><title/><defs/><style/><circle r=1 /><text>kept</text></svg><p>after", "kept\n\nafter"), ("<svg/>a<math/>b", "ab"), ("<svg><g><text>l<p>out", "l\n\nout"),
    ("<svg><text display='none'>no</text><g visibility=hidden><text>no</text></g><foreignObject><p>in</p></foreignObject></svg>", "in"), ("<svg style='display:none'><text>no</text></svg>x", "x"),
    ("<object data=a.swf><p>fallback</object>x", "fallback\n\nx"), ("<video>no</video><audio>no</audio><canvas>no</canvas><iframe>no</iframe><noscript>no</noscript>x", "x"),
]


def test_math_svg_and_fallbacks():
    for html, want in FOREIGN:
        assert extract_text(html) == want, html
    assert extract_text("<svg>" + "<g>" * 20_000 + "<text>x") == "x"


def test_deep_tables_keep_all_text():
    n = 10_000
    text = extract_text("".join(f"<table><tr><td>w{i}" for i in range(n)))
    assert text.split() and [w for w in text.replace("|", " ").split()] == [f"w{i}" for i in range(n)]


def test_long_malformed_pages_take_linear_time():
    pages = ["<a " * 300_000, "<b>" * 100_000 + "</x>" * 100_000, "<i>" * 100_000 + "<div>" * 50_000, "<a b='" * 100_000, '<a "x>y ' * 20_000, "x<!--" * 100_000]
    begun = time.process_time()
    for p in pages:
        extract_text(p)
    assert time.process_time() - begun < 60
