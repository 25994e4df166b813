import random
import re
from html.parser import HTMLParser

from ticketlens.llm.html_render import MAX_DEPTH, render, rendered


def test_blocks_lists_and_implied_tags():
    assert render("<p>one<p>two<br>three<ul><li>a<li>b<ol start=9><li>c<li>d</ol></ul>end") == (
        "one\n\ntwo\nthree\n\n- a\n- b\n  9. c\n  10. d\n\nend")
    assert render("<dl><dt>t<dd>x<dd>y</dl><blockquote>q</blockquote>") == "t\n  x\n  y\n\n  q"
    assert render("<h1>T</h1><div>a  b\n c</div><div>d</div><pre> x\n   y</pre>") == "T\n\na b c\nd\n\n x\n   y"


def test_table_cells_are_aligned():
    assert render("<table><tr><th>Name<th>N<tr><td>long name<td>3<tr><td colspan=2>both<tr><td rowspan=2>r<td>1"
                  "<tr><td>2</table>") == "Name       N\nlong name  3\nboth\nr          1\n           2"
    assert render("<table><td>a<td>b<table><tr><td>in<td>ner</table></table>after") == "a  b\n\n   in  ner\n\nafter"
    wide = "w" * 5000
    out = render(f"<table><tr><td>{wide}<td>x<tr><td>a<td>b</table>")
    assert out.split("\n")[0] == f"{wide}  x" and len(out.split("\n")[1]) < 100


def test_visibility():
    page = ("<head><title>t</title><style>p{}</style></head><script>var a='<p>no</p>'</script><!-- <p>no -->"
            "<p hidden>no</p><div style='display: none'>no<p>no</div><span style='visibility:hidden'>no"
            "<b style='visibility:visible'>yes</b></span><template>no</template><dialog>no</dialog>"
            "<noscript>no</noscript><nav>menu</nav>")
    assert render(page) == "yes\nmenu"


def test_odd_input():
    assert render(None) == render("") == render("<!-- open") == ""
    assert render("a < b & c &lt;d&gt; &nbsp;e") == "a < b & c <d>  e"
    assert render("<a href='x>y'>link</a></p><td>cell</td><p title=\"unclosed>text") .startswith("link")
    assert render("<textarea> a <b></textarea>") == " a <b>"
    deep = "<div>" * 100_000 + "x" + "</div>" * 100_000 + "y"
    assert render(deep) == "x\ny"
    assert render("<ul><li>" * 2000 + "z").endswith("z") and MAX_DEPTH < 2000
    assert render("<td>bare<tr>rows</li></ul></table>") == "barerows"
    assert len(render("<table>" + "<tr><td colspan=99999 rowspan=99999>x" * 200 + "</table>")) < 10_000


class _Words(HTMLParser):
    """Visible words by plain rules: for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.words.append(" ")
        elif self.off or tag in ("script", "style") or ("hidden", None) in attrs:
            self.off += 1
        elif tag not in ("b", "i"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        if self.off:
            self.off -= 1
        elif tag not in ("b", "i"):
            self.words.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def _page(rnd, depth=0):
    parts = []
    for _ in range(rnd.randrange(1, 5)):
        kind = rnd.randrange(8) if depth < 4 else 0
        if kind <= 2:
            parts.append(rnd.choice(["word ", "two words", " x&amp;y ", "é\n"]))
        elif kind == 3:
            tag = rnd.choice("bi")
            parts.append(f"<{tag}>inline</{tag}>")
        elif kind == 4:
            parts.append(f"<div{rnd.choice(['', ' hidden', ' id=q'])}>{_page(rnd, depth + 1)}</div>")
        elif kind == 5:
            parts.append("<ul>" + "".join(f"<li>{_page(rnd, depth + 1)}</li>" for _ in range(2)) + "</ul>")
        elif kind == 6:
            parts.append("<script>if (a < b) {}</script><br>")
        else:
            parts.append(f"<section>{_page(rnd, depth + 1)}</section>")
    return "".join(parts)


def test_all_visible_words_in_order_as_brute_force():
    for seed in range(300):
        page = _page(random.Random(seed))
        plain = _Words()
        plain.feed(page)
        plain.close()
        want = "".join(plain.words).split()
        got = [w for line in render(page).split("\n") for w in re.sub(r"^(\s*-( |$))+", "", line).split()]
        assert got == want, page


def test_column(spark):
    rows = [(1, "<p>a", "k"), (2, None, "k"), (3, "", "k"), (1, "<p>a", "k")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(r["t"] for r in frame.select(rendered("html").alias("t")).collect()) == ["", "", "a", "a"]
    assert frame.where("false").select(rendered("html")).count() == 0


def test_formulas_and_svg_labels_are_visible():
    assert render("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mi>y</mi><annotation>no</annotation>"
                  "<mphantom><mi>no</mi></mphantom></math> holds") == "so x= 1 2 y holds"
    svg = ("<svg viewBox='0 0 9 9'><title>no</title><style/><defs><text>no</text></defs><desc>no</desc><g>no<path d='M0'/>"
           "<text x=1>Sales <tspan>2024</tspan></text><text>Costs<![CDATA[ a<b &amp;]]></text><text display='none'>no</text></g></svg>")
    assert render(f"<p>a{svg}b") == "a Sales 2024 Costs a<b &amp; b"
    assert render("<svg><foreignObject><p>inside</p></foreignObject><title/><p>left</p>") == "inside\n\nleft"
    assert render(f"<p hidden>{svg}<math><mi>no</mi></math></p>end") == "end"


def test_hidden_text_stays_hidden_beyond_the_depth():
    for n in (MAX_DEPTH - 2, MAX_DEPTH - 1, MAX_DEPTH, MAX_DEPTH + 1, 3 * MAX_DEPTH):
        deep = "<span>" * n
        assert render(f"{deep}<div hidden>no<b>no</b>no<p>no</div>yes") == "yes", n
        assert render(f"{deep}<b style='visibility:hidden'>no<i>no</i>no<i style='visibility:visible'>yes</i></b>") == "yes", n
        lines = render(f"{deep}<div>a<p hidden>no<p>b<ul><li hidden>no<li>c</ul></div>d").replace("- ", "").split()
        assert lines == ["a", "b", "c", "d"], n
    assert render("<p><button>" + "<div>" * 50_000 + "<i hidden>no") == ""


def _columns_by_grid(rows):
    """The columns of cells (across, down), by marking every spanned place."""
    taken, out = set(), []
    for y, cells in enumerate(rows):
        x, columns = 0, []
        for across, down in cells:
            while (y, x) in taken:
                x += 1
            columns.append(x)
            taken |= {(y + j, x + i) for j in range(1, down) for i in range(across)}
            x += across
        out.append(columns)
    return out


def test_spans_as_intervals_place_cells_like_a_grid():
    from ticketlens.llm.html_render import Table
    rnd = random.Random(3)
    for _ in range(300):
        rows = [[(rnd.choice([1, 1, 2, 5]), rnd.choice([1, 1, 2, 3, 7])) for _ in range(rnd.randint(0, 6))] for _ in range(rnd.randint(1, 9))]
        t = Table()
        for cells in rows:
            t.row()
            for across, down in cells:
                t.cell([], across, down)
        assert [[c for c, _, _ in r] for r in t.rows] == _columns_by_grid(rows)


def test_time_of_wide_and_long_spans():
    import time
    begin = time.process_time()
    for page in ("<table>" + "<td rowspan=1000 colspan=1000>x" * 3000, "<table>" + "<tr><td rowspan=1000 colspan=1000>x" * 3000):
        assert render(page).count("x") == 3000
    assert time.process_time() - begin < 20


def test_query_on_nulls_repeats_and_an_empty_table(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    rows = [(1, "<p>a", "clash"), (1, "<p>a", "clash"), (None, "<b>b", "clash"), (2, None, "clash"), (3, "", "clash")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    for name, part, want in (("some", frame, [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0), (None, "b", 1)]), ("none", frame.limit(0), [])):
        part.write.parquet(str(tmp_path / name / "pages.parquet"))
        got = [tuple(r) for r in QUERIES["op6_html_extraction"](spark, str(tmp_path / name)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
