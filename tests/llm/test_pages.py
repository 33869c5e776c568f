import html as entities
import re

import pytest
from pyspark.sql import functions as F

from wildgrid.llm.pages import extract, host_of, main_text, movers, nested, order_of, templates


@pytest.mark.parametrize("page, text", [
    ("", ""), ("no markup &amp; all", "no markup & all"), ("<p>a<p>b", "a b"),
    ("<article><p>one<b>two</b> three<br>four</p></article>", "onetwo three four"),
    ("<nav>menu</nav><article>a<aside>side</aside>b</article><footer>f</footer>", "a b"),
    ("<article>x<script>var a = '</article>';</script>y</article>z", "xy"),
    ("<main><article>a</article></main><div class='sidebar'>s</div>", "a"),
    ("<article><div class=\"cookie-notice\">ok?</div><p>t &lt;3 &#233;</p><form>f<input></form></article>", "t <3 é"),
    ("<article><p>t</p><section id=comments><article>nice text from a reader</article></section></article>", "t"),
    ("<div class=ad>buy</div><div id=content><p>long enough text</p></div>", "long enough text"),
    ("<body class='has-sidebar'><article>real text</article>", "real text"),
    ("<main><article class='post ad-free'>real text</article></main>", "real text"),
    ("<main><article>one</article><div class='ad'>buy</div><article>the second</article></main>", "one the second"),
    ("<article>one <article>two</article> three</article>", "one two three"),
    ("<article>t<div><article class='comment'>a reader's words</article></div></article>", "t"),
    ("<div><section><p>first block</p></section><section><p>second, longer block</p></section></div>",
     "first block second, longer block"),
    ("<article>a<!-- c --> b\n\n\t c<article", "a b c"), ("<article>1 < 2</article>", "1 < 2"),
])
def test_one_page(page, text):
    assert main_text(page) == text


def test_tables_against_their_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in extract(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page["html"], re.S)[1]
        inner = re.sub(r"<(?!/?b>)[^>]*>", " ", inner)
        want = " ".join(entities.unescape(re.sub(r"</?b>", "", inner)).split())
        assert found[page["page_id"]]["text"] == want
        assert found[page["page_id"]]["n_chars"] == len(want)


def test_template_of_a_host(spark):
    page = ("<body><div class='top'>Daily News</div><div class='text'><h2>By our staff</h2><p>{0} one.</p>{1}</div>"
            "<div class='more'>Read on elsewhere</div></body>")
    rows = [(i, "http://n.example/%d" % i, page.format(f"Story {i}", "<p>And more of it.</p>" * (i % 3)))
            for i in range(20)]
    rows += [(100, "http://few.example/x", page.format("Alone", "<p>And more of it.</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["host"] for r in templates(pages).collect()} == {"n.example"}
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert found[5] == "Story 5 one. And more of it. And more of it."
    assert found[100].startswith("By our staff Alone one.")


def test_copies_are_no_template(spark):
    rows = [(i, "http://c.example/", "<article><h1>Title</h1><div>the same text in all pages</div></article>")
            for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in extract(pages).collect()} == {"Title the same text in all pages"}


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>t"), (2, "HTTP://u@A.b:80/c", ""), (3, "", "<" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    found = extract(pages).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract(pages.where("page_id = 77")).count() == 0
    assert [r[0] for r in pages.where("page_id = 2").select(host_of(F.col("url"))).collect()] == ["a.b"]


def test_orders_and_nests():
    assert order_of(list("abab")) == (False, list("ab")) and order_of(list("aabb")) == (True, list("aabb"))
    assert movers(list("abcx"), list("xabc")) == {"x"} and not movers(list("abab"), list("ab"))
    assert len(movers(list("aabb"), list("ab"))) == 1
    a, b, c = list("aceg"), list("bd"), list("hi")
    every = [(0, -1, 0, 20), (1, -1, 0, 12), (2, -1, 0, 12)]
    assert nested([a, b, c], [*every, (1, 0, 1, 12), (2, 0, 3, 12)]) == [a, b, c]
    assert nested([a, b, c], [*every, (1, 0, 1, 12), (1, 0, 0, 12), (2, 0, 3, 12)]) == [a, c]  # b ends elsewhere
    assert nested([a, b, c], [*every, (1, 0, 1, 7), (1, 0, 2, 5), (2, 0, 3, 11)]) == [a]  # b moves, c is once outside


def test_classes_are_ordered_nested_and_told_apart_by_gaps(spark):
    """Texts that are only by chance as frequent as the template stay; headings in a gap of their own go."""
    page = ("<body><div class='text'><div class='one'>{0}</div><div class='two'>{1}</div><p>Story {2} "
            "has its own many words here.</p><div class='three'>{3}</div></div></body>")
    hosts = {
        # Two notes that change places from page to page: one of them has no place in the template.
        "moves": lambda i: page.format("", "<i></i>", i, "Note A<br>Note B" if i % 2 else "Note B<br>Note A"),
        # A class of the pages but two begins inside the class of all pages and ends after its last token.
        "crosses": lambda i: page.format("Begin" * (i > 1), "", i, "End" * (i > 1)),
        # The heading is in a fixed place in all pages, and elsewhere in some.
        "roles": lambda i: page.format("", "", i, "").replace("<p>", "<h2>Latest</h2><p>").replace(
            "<div class='three'>", "<div class='three'></div>" + "<h2>Latest</h2>" * (i % 3 == 0)),
        # Each page comes twice.
        "twice": lambda i: page.format("", "", i, "<br>".join(["Alpha"] * (i < 12) + ["Beta"] * (i > 7))),
    }
    rows = [(i, f"http://{host}/", make(i)) for host, make in hosts.items() for i in range(20)
            for _ in range(1 + (host == "twice"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {(r["url"][7:-1], r["page_id"]): r["text"] for r in extract(pages).collect()}
    story = "Story {} has its own many words here."
    notes = {found["moves", i].removeprefix(story.format(i)).strip() for i in range(20)}
    assert notes in ({"Note A"}, {"Note B"})
    assert found["crosses", 9] == f"Begin {story.format(9)} End"
    assert found["roles", 1] == story.format(1) and found["roles", 3] == f"{story.format(3)} Latest"
    assert found["twice", 3] == f"{story.format(3)} Alpha" and found["twice", 9] == f"{story.format(9)} Alpha Beta"
