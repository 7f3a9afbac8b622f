"""Layout assertions one by one, nested intervals, subtree signatures."""

import pytest

from veritrail.operators import layout as L

QUESTION = '<div class="accordion-item"><button class="accordion-headline" id="q" aria-controls="a"><h2>Why?</h2></button><div class="accordion-content" id="a" aria-labelledby="q"><p>So.</div></div>'
PAGE = (
    '<body><div class="content"><nav class="nav-breadcrumb">x</nav><div class="frame"><nav class="toc"><ul><li><a href="#one">One</a><li><a href="#two">Two</a></ul></nav>'
    '<h2 id="one">One</h2><p id="two">Two</div><div class="frame"><div><header><h2>Questions</h2></header></div><div class="accordion">' + QUESTION + "</div></div></div></body>"
)
CHANGES = {
    "good": ("", "", set()),
    "no container": ('class="content"', "", {("site_layout_mismatch", "")}),
    "loose text": ('<div class="frame"><nav', 'loose<div class="frame"><nav', {("site_unselected_content", "/1")}),
    "unknown frame": ('<div class="frame"><nav', '<aside>x</aside><div class="frame"><nav', {("site_unselected_content", "/3")}),
    "no contents": ('class="toc"', "", {("site_toc_mismatch", "")}),
    "item without link": ('<li><a href="#two">Two</a>', "<li>Two", {("site_toc_mismatch", "")}),
    "no target": ('id="two"', "", {("site_toc_target_mismatch", "#two")}),
    "two targets": ('id="one"', 'id="two"', {("site_toc_target_mismatch", "#one"), ("site_toc_target_mismatch", "#two"), ("duplicate_element_id", "#two")}),
    "target inside": ('<li><a href="#two">Two</a>', '<li><a href="#in">Two</a><b id="in">x</b>', {("site_toc_target_mismatch", "#in")}),
    "link to elsewhere": ('href="#two"', 'href="/two"', {("site_toc_target_mismatch", "/9")}),
    "group without title": ("<header><h2>Questions</h2></header>", "<h2>Questions</h2>", {("site_faq_group_missing", "/15")}),
    "controls another": ('aria-controls="a"', 'aria-controls="b"', {("site_faq_mismatch", "/17")}),
    "labelled by another": ('aria-labelledby="q"', "", {("site_faq_mismatch", "/17")}),
    "no answer": ('class="accordion-content"', "", {("site_faq_mismatch", "/17")}),
    "empty answer": ("<p>So.", "So.", {("site_faq_mismatch", "/17")}),
    "text in the button": ("</h2></button>", "</h2>more</button>", {("site_faq_mismatch", "/17")}),
    "two headings": ("</h2></button>", "</h2><h2>y</h2></button>", {("site_faq_mismatch", "/17")}),
    "no item": ('class="accordion-item"', "", {("site_faq_mismatch", "/17")}),
    "second button": ("</button>", '</button><button class="accordion-headline" id="r" aria-controls="a"><h2>x</h2></button>', {("site_faq_mismatch", "/17")}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, PAGE.replace(old, new) if old else PAGE) for name, (old, new, _) in CHANGES.items()]
    got: dict = {}
    for r in L.layout_violations(spark.createDataFrame(rows + [("null", None), ("empty", "")], "name string, html string"), "name", "html").collect():
        got.setdefault(r["name"], []).append((r["code"], r["at"]))
    return got


@pytest.mark.parametrize("name", CHANGES)
def test_one_change_breaks_its_assertions(found, name):
    old, _, expected = CHANGES[name]
    assert not old or PAGE.count(old) >= 1
    codes = found.get(name, [])
    assert set(codes) == expected and len(codes) == len(expected)


def test_pages_without_elements(found):
    assert set(found["null"]) == set(found["empty"]) == {("site_layout_mismatch", ""), ("site_toc_mismatch", "")}


def test_no_pages_and_pages_of_one_key(spark):
    empty = spark.createDataFrame([], "k long, html string, code string")
    assert L.layout_violations(empty, "k", "html").count() == 0
    twice = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "y")], empty.schema)  # its ids count once a page
    assert L.layout_violations(twice, "k", "html").count() == 0


def test_elements_are_nested_intervals():
    rows = L.page_elements("<div><p>a<p>b <i>c</i><br><ul><li>x<li><b>y</ul></section></div><hr><table><tr><td>1<td>2<tr><td>3</table>")
    tags = [r["tag"] for r in rows]
    assert tags == "div p p i br ul li li b hr table tr td td tr td".split()
    for r in rows:
        inside = [x["ord"] for x in rows if r["ord"] < x["ord"] <= r["last"]]
        below = []
        for x in rows:
            up = x["parent"]
            while up >= 0 and up != r["ord"]:
                up = rows[up]["parent"]
            below += [x["ord"]] if up == r["ord"] else []
        assert inside == below
    assert [r["parent"] for r in rows] == [-1, 0, 0, 2, 2, 0, 5, 5, 7, -1, -1, 10, 11, 11, 10, 14]
    assert [r["before"] for r in rows] == [-1, -1, 1, -1, 3, 2, -1, 6, -1, 0, 9, -1, -1, 12, 11, -1] and rows[2]["text"] == "b"


def test_reading_of_marks():
    page = "<P Title=\"a>b\" x=1 y x=2 z='&lt;'>a &amp; b<script>if (a<b) \"<p>\"</SCRIPT ><br/>c <img src=a/b.png> 1 < 2</P><!-- <i> --><title>x <b></title><b <u>t<!-- <i>"
    rows = L.page_elements(page)
    assert [(r["tag"], r["text"]) for r in rows] == [("p", "a & b c 1 < 2"), ("script", 'if (a<b) "<p>"'), ("br", ""), ("img", ""), ("title", "x <b>"), ("u", "t")]
    assert rows[0]["attrs"] == {"title": "a>b", "x": "1", "y": "", "z": "<"} and rows[3]["attrs"] == {"src": "a/b.png"}


@pytest.mark.parametrize("part", ["<a <a ", '<a "', "<!-- ", "<p>", "<script>", "<a b=\"'>", "</x>", "<!x", "&", "<"])
def test_long_broken_pages_take_linear_time(part):
    import time

    start = time.perf_counter()
    L.page_elements(part * 100_000)
    assert time.perf_counter() - start < 20


def test_signatures_cover_the_whole_subtree():
    sign = lambda page: L.page_elements(page, signed=True)[0]["signature"]
    base = sign('<div class="g" id="x"><img src="a"><p>t &amp; u</p></div>')
    assert base == sign('<div id="x" class="g">\n <img src="a">\n<p> t & u </p></div>')
    others = ['<div class="g" id="y"><img src="a"><p>t & u</p></div>', '<div class="g" id="x"><img src="b"><p>t & u</p></div>', '<div class="g" id="x"><img src="a"><p>t & v</p></div>']
    others += ['<div class="g" id="x"><p>t & u</p><img src="a"></div>', '<div class="g" id="x"><img src="a"><b>t & u</b></div>', '<div class="g" id="x"><img src="a">t & u<p></p></div>']
    assert len({base, *map(sign, others)}) == 7


def test_media_are_listed_for_their_url_only(spark):
    box = '<div class="gallery"><div class="gallery"><img src="a"></div></div>'
    pages = spark.createDataFrame([(1, "u", box), (2, "v", box), (3, None, box), (4, "u", box.replace('"a"', '"b"')), (5, "u", None)], "k long, url string, html string")
    signed = [(r["kind"], r["signature"]) for r in L.subtree_signatures(pages.where("k = 1"), "k", "html", {"gallery": "gallery"}).collect()]
    allowed = spark.createDataFrame([("u", *x) for x in signed], "url string, kind string, signature string")
    left = sorted((r["k"], r["ord"]) for r in L.media_violations(pages, allowed, "k", "url", "html", {"gallery": "gallery"}).collect())
    assert len(signed) == 2 and left == [(2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]
