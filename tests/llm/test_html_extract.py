import html
import json
import re

from pyspark.sql import functions as F

from tabaudit.llm import html_extract as H
from tests.conftest import SF01
from tests.llm.helpers import clashing


def text_of(page, wrapper=None):
    return H.extract(H.parse(page), wrapper)


def test_blocks_references_and_white_space():
    page = "<article><h1>A &amp; B</h1><p>one\n  two&nbsp;<b>th</b>ree<br>four<p>five &#8364;<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table></article>"
    assert text_of(page) == "A & B\none two three four\nfive €\nx\ny\nc1\nc2"


def test_parts_that_are_no_content():
    page = ("<html><head><title>t</title><style>p{}</style></head><body><header>h</header><nav>n</nav><div class='cookie-notice'>c</div><article>"
            "<p>text<script>var a='</p><p>no';</script> more</p><!-- <p>hidden</p> --><div class='ad box'>buy</div><form>f<input></form>"
            "<div id=comments><p>nice</p></div><aside>s</aside></article><footer>&copy;</footer></body>")
    assert text_of(page) == "text more"


def test_malformed_pages():
    assert text_of("") == "" and text_of("no markup at all") == "no markup at all"
    assert text_of("<article><p>a<b>b</p>c</article") == "ab\nc"
    assert text_of("<article><p>a < b > c & d</p></article>") == "a < b > c & d"
    assert text_of("<div><p>x</div></p></div>y") == "x\ny"
    assert text_of("<p title='a>b'>in</p><p title=\"open>still") .startswith("in")
    assert text_of("<!-- never closed <p>x") == "" and text_of("<script>never closed <p>x") == ""
    assert text_of("<div>" * 3000 + "deep") in ("deep", "")


def test_text_at_any_depth_is_kept():
    for tag in ("div", "section", "blockquote"):
        deep = f"<{tag}>" * 3000 + "deep"
        assert text_of(deep) == "deep" and text_of("<article><p>top</p>" + deep) == "top\ndeep"
        assert text_of(deep, H.skeleton(H.parse(deep))) == "deep"
        assert text_of("<article>" + f"<{tag}>" * 3000 + "deep" + f"</{tag}>" * 3000 + "<p>end</p></article>") == "deep\nend"


def test_articles_are_the_content_only_if_they_hold_most_of_it():
    story = "<p>The long main text of the page.</p><p>It has more than one paragraph.</p>"
    cards = "<article>Card one</article><article>Card two</article>"
    lines = ["The long main text of the page.", "It has more than one paragraph."]
    for tag in ("div", "main"):
        got = text_of(f"<body><{tag}>{story}</{tag}><section>{cards}</section></body>").split("\n")
        assert got[:2] == lines, tag
    parts = "".join(f"<article><p>part {i} {'x' * (9 - i)}</p></article>" for i in range(3))
    assert text_of(f"<div>{parts}</div><p>by</p>") == "part 0 xxxxxxxxx\npart 1 xxxxxxxx\npart 2 xxxxxxx"
    # what a host repeats does not count: the article is long and constant, the text varies
    pages = [f"<article><p>{'The same terms on every page. ' * 3}</p></article><div><p>Story {i}</p><p>More {i}</p></div>" for i in range(8)]
    tree = H.skeleton(H.parse(pages[0]))
    for p in pages[1:]:
        tree = H.merge(tree, H.skeleton(H.parse(p)))
    assert text_of(pages[2], tree).endswith("Story 2\nMore 2")


def test_constant_parts_of_a_host_are_template():
    pages = [f"<div class=top><span>Site of things</span></div><div class=body><p>Story {i} about {i * 7}</p><p>More of story {i}</p><p>Read on tomorrow</p></div>"
             f"<div class=links><a href=1>One {i}</a> <a href=2>Two</a></div>" for i in range(12)]
    tree = H.skeleton(H.parse(pages[0]))
    for p in pages[1:]:
        tree = H.merge(tree, H.skeleton(H.parse(p)))
    assert tree.pages == 12
    page = pages[3].replace("Story 3", "Story 3 is long " * 9)
    got = text_of(page, tree)
    assert "Story 3" in got and "Site of things" not in got and "Read on tomorrow" not in got and "Two" not in got
    again = H.Template.of_list(tree.to_list())
    assert text_of(page, again) == got


def test_a_repeated_article_is_kept():
    page = "<article><h1>Title</h1><p>The very same story on every page of the host.</p></article>"
    tree = H.skeleton(H.parse(page))
    for _ in range(30):
        tree = H.merge(tree, H.skeleton(H.parse(page)))
    assert text_of(page, tree) == "Title\nThe very same story on every page of the host."


def test_tree_matching_is_the_largest_ordered_alignment():
    def tree(key, *kids):
        t = H.Template(key)
        t.kids = list(kids)
        return t

    a = tree("r", tree("x"), tree("y", tree("u"), tree("v")), tree("x"))
    b = tree("r", tree("y", tree("v")), tree("x"), tree("x"))
    score, pairs = H.match(a, b)
    assert score == 4 and [(i, j) for i, j, _ in pairs] == [(1, 0), (2, 2)] or [(i, j) for i, j, _ in pairs] == [(1, 0), (2, 1)]
    assert H.match(a, tree("s"))[0] == 0


def test_merged_trees_stay_bounded(monkeypatch):
    monkeypatch.setattr(H, "MAX_NODES", 30)
    tree = H.skeleton(H.parse("<div class=a><p>x</p></div>"))
    for i in range(60):
        tree = H.merge(tree, H.skeleton(H.parse(f"<div class=a><p>x</p></div><section class={'q' * (i + 1)}>y</section>")))
    assert tree.size() <= 30 and any(k.key == "div.a" for k in tree.kids)


def test_awkward_rows(spark):
    rows = [(1, "http://a.example/x", "<article><p>hi</p></article>"), (1, "http://a.example/x", "<article><p>hi</p></article>"), (2, None, "<p>no address</p>"),
            (3, "http://a.example/y", None), (None, "not an address", ""), (4, "HTTP://A.example:80/z", "<p>" + "long " * 100000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "host", "tree", "part")
    for kw in ({}, {"broadcast_bytes": -1}):
        out = H.extract_pages(df, **kw).collect()
        got = sorted(((r.page_id, r.url, r.text[:20], r.n_chars) for r in out), key=repr)
        assert got == sorted([(1, "http://a.example/x", "hi", 2)] * 2 + [(2, None, "no address", 10), (3, "http://a.example/y", "", 0), (None, "not an address", "", 0),
                              (4, "HTTP://A.example:80/z", "long long long long ", 499999)], key=repr)
    assert H.extract_pages(df.limit(0)).count() == 0


def test_copies_count_once_whatever_the_partitions(spark):
    """40 copies of a page, in as many tasks or in one, make none of its text template."""
    copy = "".join(f"<p>Passage {k} of the copied page.</p>" for k in range(8))
    rows = [(i, "http://c.example/x", f"<div>{copy}</div>") for i in range(40)]
    for i in range(10):
        quoted = "<p>Passage 3 of the copied page.</p>" if i < 2 else ""
        story = "".join(f"<p>Story {i} is told here at some length, part {k}.</p>" for k in range(6))
        rows.append((100 + i, "http://c.example/y", f"<div>{quoted}{story}</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 50):
        got = {r.page_id: r.text for r in H.extract_pages(df.repartition(n)).collect()}
        assert got[0].count("Passage") == 8
        assert [i for i in range(10) if "Passage 3" in got[100 + i]] == [0, 1], n


def test_template_of_long_pages_is_found_whole(spark):
    """Lines on half of a host's pages of 90 paragraphs are template, a line on
    40 % is not, whatever the order and the partitions."""
    rows = []
    for i in range(60):
        ps = [f"Story {i} goes on in paragraph {k}." for k in range(90)]
        ps[i:i] = [f"Read our terms, part {j}." for j in range(6) if (i + j) % 2 == 0] + ["Told by our own writers."] * (i % 5 > 2)
        rows.append((i, "http://l.example/x", "<div>" + "".join(f"<p>{p}</p>" for p in ps) + f"<section class='{chr(97 + i % 26) * (i + 1)}'>s{i}</section></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = [{r.page_id: r.text for r in H.extract_pages(d).collect()} for d in (df.coalesce(1), df.orderBy(F.desc("page_id")).repartition(9))]
    assert results[0] == results[1]
    for i, text in results[0].items():
        assert "Read our terms" not in text and ("Told by our own writers." in text) == (i % 5 > 2)
        assert text.count("Story") == 90 and text.endswith(f"s{i}")


def test_counts_equal_merged_trees(spark):
    """On pages of one template the counted wrapper is that of merged trees."""
    pages = [f"<div class=top><a href=1>Home</a></div><div><p>Story {i}</p><p>Always here</p><p>{'odd' if i % 2 else 'even'}</p></div>" for i in range(12)]
    tree = H.skeleton(H.parse(pages[0]))
    for p in pages[1:]:
        tree = H.merge(tree, H.skeleton(H.parse(p)))
    df = spark.createDataFrame([("h", p) for p in pages * 2], "host string, html string")
    got = H.Wrapper.of_bytes(H.induce(df.repartition(5)).first()["wrapper"])
    assert got == H.Wrapper.of_tree(tree) and got.links and len(got.texts) == 4


def test_test_table_pages(spark):
    """On the table's pages the article's headings and paragraphs are the main text."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    for r in H.op9_html_extract(spark, SF01).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_labels_are_evidence_only():
    """Modifiers, page bodies, and parts that hold the article are no asides."""
    t = "Main text of a page that is long enough to matter."
    for page in (f'<html><body class="has-sidebar"><p>{t}</p></body></html>', f'<main class="content no-sidebar"><p>{t}</p></main>',
                 f'<div class="page-wrap with-menu"><p>{t}</p></div>', f'<form id="aspnetForm"><div><p>{t}</p></div></form>',
                 f'<div class="comments"><main><p>{t}</p></main></div>',
                 f'<p>{t}</p><div class="sidebar">x</div><form>Your name</form><section class="comments">Nice</section>'):
        assert H.extract(H.parse(page), None) == t


def test_many_unclosed_tags_take_linear_time():
    import time
    start = time.time()
    for page in ("<div>" * 40_000 + "deep", "<p><div>" * 40_000 + "</p>deep", "<b><i>" * 40_000 + "deep</b>"):
        assert H.extract(H.parse(page), None) == "deep"
    assert time.time() - start < 20


def test_pages_are_aligned_with_their_hosts_template_by_tree_matching(spark):
    """Two parts of one label that stand on either side of another are two nodes."""
    first = H.Template.of_list(["#root", 1, 0, 0, [], [["div.a", 1, 0, 0, [], []], ["div.b", 1, 0, 0, [], []]]])
    other = H.Template.of_list(["#root", 1, 0, 0, [], [["div.b", 1, 0, 0, [], []], ["div.a", 1, 0, 0, [], []]]])
    page = H.Template.of_list(other.to_list())
    assert H.align(first, H.Template.of_list(first.to_list())) == {}
    host = H.merge(first, other)
    assert sorted(k.key for k in host.kids) in (["div.a", "div.a", "div.b"], ["div.a", "div.b", "div.b"])
    a, b = (H.align(host, H.Template.of_list(x)) for x in (["#root", 1, 0, 0, [], [[k, 1, 0, 0, [], []] for k in ks]] for ks in (("div.a", "div.b"), ("div.b", "div.a"))))
    assert a != b
    rows = [(i, f"http://h.org/{i}", f"<div class=a>{'x' * (i + 1)} words</div><div class=b>Same line</div>" if i % 2 else
             f"<div class=b>Same line</div><div class=a>{'y' * (i + 1)} words</div>") for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    trees = H.templates(df.select(H.host_of(F.col("url")).alias("host"), "html")).collect()
    assert len(trees) == 1 and len(H.Template.of_list(json.loads(trees[0]["template"])).kids) == 3
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    assert len(got) == 24 and all("words" in t for t in got.values())
