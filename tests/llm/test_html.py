import pytest

from duesight.llm import html

CASES = {
    None: "", "": "", "plain": "plain", "<p>a &amp; b&nbsp;\n c</p>": "a & b c",
    "<body><nav>menu</nav><article><h1>T</h1><p>one<b> two</b><br>three<p>four</article><footer>f</footer></body>":
        "T\none two three\nfour",
    "<article><p>a</p><aside>side</aside><form><input>f</form><script>var t='</p>';</script><style>p{}</style>"
    "<div class='ad'>buy</div><section id=comments><p>bad</p></section><p>b</p></article>": "a\nb",
    "<main><div class='cookie-notice'>x</div><ul><li>i<li>j</ul><table><tr><td>c<td>d</table></main>": "i\nj\nc\nd",
    "<article><p>open": "open", "<article><!-- c --><p>x<!-- <p>no</p> -->y</p></article>": "xy",
    "<body><header>Top</header><p>text</p></body>": "text", "a < b and c > d": "a < b and c > d",
    "<article><header><h1>Title</h1></header><p>x</p></article>": "Title\nx",
    "<article><p>main text here</p></article><article class='comment'><p>c</p></article>": "main text here",
    "<article><p>" + "w " * 200_000 + "</p></article>": " ".join(["w"] * 200_000),
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_main_text(page):
    assert html.main_text(page)[0] == CASES[page]


def page(n, ad=True, extra=""):
    body = "".join(f"<p>paragraph {i}</p>" for i in range(n))
    return (f"<html><body><nav><ul>{'<li><a>x</a></li>' * (n + 2)}</ul></nav>{'<div class=ad>buy</div>' if ad else ''}"
            f"<article><h1>Head {n}</h1>{body}{extra}</article><footer>foot</footer></body></html>")


def wrapper_of(pages):
    import re
    pattern, symbols = html.compiled(html.infer([html.symbols_of(html.tokens(p)) for p in pages]))
    return re.compile(pattern), {s: chr(html.FIRST + i) for i, s in enumerate(symbols)}


def test_wrapper_generalises_repeats_and_optional_groups():
    wrapper = wrapper_of([page(2), page(3, ad=False), page(4, extra="<blockquote>q</blockquote>")])
    for p in (page(9), page(2, ad=False), page(5, False, "<blockquote>other</blockquote>"), page(7, True)):
        text, matched = html.main_text(p, wrapper)
        assert matched and text == html.main_text(p)[0]
    assert not html.main_text("<div>quite another page</div>", wrapper)[1]


def test_matching_takes_time_in_proportion():
    wrapper = wrapper_of([page(2), page(3, ad=False), page(40)])
    assert html.main_text(page(20_000) + "<i>tail</i>" * 5, wrapper)[0].count("\n") == 20_000


def test_pages_as_a_table(spark):
    rows = [(i, f"https://{'hot' if i % 3 else 'h' + str(i)}.example.com/{i}", page(i % 7 + 1, i % 2 == 0), 1, "p") for i in range(60)]
    rows += [(60, None, page(3), 1, "p"), (61, "https://hot.example.com/n", None, 1, "p"), (62, "", "", 1, "p"), rows[1], (None, "x", page(1), 1, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, pattern string")
    found = html.extracted(df).collect()
    assert len(found) == len(rows)
    want = {r[0]: html.main_text(r[2])[0] for r in rows}
    for r in found:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    assert sum(r["by_wrapper"] for r in found) > 50
    assert html.extracted(df.limit(0)).count() == 0


def test_a_layout_that_one_page_of_many_has_is_in_the_wrapper(spark):
    """Whichever page has it, and however few forms make a group."""
    rows = [(i, "https://one.example.com/", f"<html><body><div class='c{i}'><b>x</b></div><article><p>a {i}</p></article></body></html>")
            for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for forms in (64, 4):
        found = html.extracted(df, forms).collect()
        assert [r for r in found if not r["by_wrapper"]] == []
        assert {r["page_id"]: r["text"] for r in found} == {i: f"a {i}" for i in range(40)}


def test_a_wrapper_that_outgrows_is_none():
    many = [[f"div.{i}", "/div", "article", "#", "/article"] for i in range(html.ITEMS)]
    assert html.infer(many) == [] and html.infer(many[:3])
