"""Main text of hand-made pages, and alignment of the pages of a host."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.wrappers import Template, extract, fold, main_text, match, merge
from corpusloom.llm.dom import parse

PAGES = [
    ("<article><h1>A&amp;B</h1><p><b>Bold<br><p>x  y\n z</p></article><footer>f</footer>", "A&B Bold x y z"),
    ("<nav>n</nav><header>h</header><main><p>one<p>two <i>three</i>four</main><aside>s</aside>", "one two threefour"),
    ("<body><div class='ad'>x</div><div><p>text</p><div id=cookie-notice>c</div></div><form>f</form></body>", "text"),
    ("<article><p>a</p><section class='comments'><article><p>reader</p></article></section></article>", "a"),
    ("<article>t<script>var a='</p><p>no';</script><style>p{}</style><!-- c --><p>u</article>", "t u"),
    ("<article><header><h1>Title</h1></header><p>body</p><footer>by</footer></article>", "Title body"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    ("<div><ul><li><a href=x>m</a></li><li><a>n</a></li></ul><p>1 &lt; 2 &eacute;&#233; & 3</p></div>", "1 < 2 éé & 3"),
    ("<article><p>cut off <a hre", "cut off"),
    ('<article><p title="a>b">q</p><p class="lead headline">r</p></article>', "q r"),
    ("<article><p hidden>x</p><p aria-hidden='true'>y</p><p>z &copy</p></article>", "z ©"),
    ("plain words only", "plain words only"),
    ("<p>a<div>b</div>c", "a b c"),
    ("", ""),
    ("<article></article>", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_deep_and_broken_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<b>" * 3000 + "x</i></b></p></article>") == "x"
    assert main_text("<p>" + "<a 'b" * 2000) == ""
    assert len(main_text("<article>" + "<p>word word</p>" * 20000)) == 20000 * 10 - 1


def trees(depth: int):
    leaf = ["#", 1, 1, []]
    if depth == 0:
        return [leaf]
    below = trees(depth - 1)
    return [[name, None, 1, list(kids)] for name in "ab" for n in (0, 1, 2) for kids in itertools.product(below[:4], repeat=n)]


def test_simple_tree_matching():
    def plain(a, b) -> int:
        if a[0] != b[0]:
            return 0
        best = 0
        for n in range(min(len(a[3]), len(b[3])) + 1):
            for left in itertools.combinations(a[3], n):
                for right in itertools.combinations(b[3], n):
                    sums = [plain(x, y) for x, y in zip(left, right)]
                    best = max(best, sum(sums) if all(sums) else 0)
        return 1 + best

    some = trees(2)
    for a in some[::3]:
        for b in some[::4]:
            if a[0] == b[0]:
                assert match(a, b, {}) == plain(a, b)


def test_templates_merge_alike_in_any_order():
    pages = [f"<div><p>same</p><p class=x>{i}</p>{'<em>more</em>' if i % 2 else ''}<span>end</span></div>" for i in range(4)]
    shapes = set()
    for order in itertools.permutations(range(4)):
        whole = None
        for i in order:
            one = Template(fold(parse(pages[i]))[0], [i])
            if whole is None:
                whole = one
            else:
                whole.add(one)
        shapes.add(whole.dumps())
    assert len(shapes) == 1
    a = fold(parse("<i>1</i>"))[0]
    merge(a, fold(parse("<i>2</i>"))[0])
    assert a[3][0][3][0][:3] == ["#", None, 2]


def test_extract(spark):
    host = "http://User@Site.example:80/p/"
    page = "<div class=c7><b>Welcome to the site</b></div><div class=q><p>story {i} {x}</p></div><div>All rights</div>"
    rows = [(i, f"{host}{i}", page.format(i=i, x="y" * i)) for i in range(12)]
    rows += [(100 + i, f"https://copies.example/{i}", "<div><p>only text</p></div>") for i in range(10)]
    rows += [(200, None, "<p>no host</p>"), (201, "relative/path", "<p>r</p>"), (202, "http://a.example", None), (203, host, ""), (200, None, "<p>no host</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit("x"))
    got = extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"story {i} {'y' * i}".strip() for i in range(12))
    assert all(text[100 + i] == "only text" for i in range(10))
    assert (text[200], text[201], text[202], text[203]) == ("no host", "r", "", "")
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
