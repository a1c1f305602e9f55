import re

import pytest

from pulsegrid.llm import html as H

SCHEMA = "page_id bigint, url string, html string"


def page(title, paragraphs, extra="", nav="<ul><li>Home</li><li>News</li></ul>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav>{nav}</nav>"
        f"<div class='cookie-notice'>We use cookies</div><!-- <p>hidden</p> --><div class=\"ad\">Buy</div><article><h1>{title}</h1>{body}{extra}</article>"
        f"<aside>Side</aside><section class='comments'><p>First!</p></section><form><button>Go</button></form><footer>&copy; me</footer></body></html>"
    )


def extracted(spark, rows):
    return {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_article_without_what_surrounds_it(spark):
    pages = [(i, f"https://a.example/{i}", page(f"T{i}", [f"one &lt;{i}&gt;  <b>bo</b>ld<br>x", "two\n three&amp;amp;"] + ["more"] * (i % 4))) for i in range(12)]
    got = extracted(spark, pages)
    for i in range(12):
        assert got[i] == " ".join([f"T{i}", f"one <{i}> bold x", "two three&amp;", *["more"] * (i % 4)])


def test_template_words_on_every_page_go_and_optional_blocks_stay(spark):
    pages = [(i, f"https://b.example/{i}", page(f"T{i}", [f"the longer text {i}"], "<div class=x>Read on</div>" + ("<ul><li>p</li><li>q</li></ul>" if i % 2 else ""))) for i in range(20)]
    got = extracted(spark, pages)
    assert got[0] == "T0 the longer text 0" and got[1] == "T1 the longer text 1 p q"
    copies = [(i, f"https://c.example/{i}", page("Same", ["one", "two"])) for i in range(20)]
    assert set(extracted(spark, copies).values()) == {"Same one two"}


def test_fixed_first_paragraph_stands_for_itself_only(spark):
    body = "<html><body><article><p>Advertisement</p><h1>T{0}</h1><figure>f{0}</figure><p>the body of {0}</p><p>more {0}</p></article></body></html>"
    got = extracted(spark, [(i, f"https://i.example/{i}", body.format(i)) for i in range(20)])
    assert got[3] == "T3 f3 the body of 3 more 3"
    # The article's way leads through the second of two blocks of one form.
    body = "<body><div><p>Same</p></div><hr><ul><li>x</li></ul><h2>y</h2><div><main><p>Fixed</p><ul><li>{0}</li></ul><h2>z{0}</h2><p>own text {0}</p></main></div></body>"
    got = extracted(spark, [(i, f"https://j.example/{i}", body.format(i)) for i in range(20)])
    assert got[3] == "3 z3 own text 3"


def test_words_of_some_pages_only_stay(spark):
    some = lambda i: "<h2>Conclusion</h2><p>end</p>" if i < 12 else ""
    pages = [(i, f"https://k.example/{i}", page(f"T{i}", [f"the longer text {i}"], "<div class=x>Read on</div>" + some(i))) for i in range(30)]
    got = extracted(spark, [*pages, (30, "https://k.example/30", None)])
    assert got[3] == "T3 the longer text 3 Conclusion end" and got[20] == "T20 the longer text 20" and got[30] == ""
    # A fixed slot inside an optional block.
    some = lambda i: "<section><h3>Author</h3><p>about {0}</p></section>".format(i) if i < 12 else ""
    got = extracted(spark, [(i, f"https://l.example/{i}", page(f"T{i}", [f"the longer text {i}"], some(i))) for i in range(30)])
    assert got[3] == "T3 the longer text 3 Author about 3"


def test_pages_without_article_elements(spark):
    body = "<body><div id=menu><p>Menu words</p></div><div class=wrap><div class=text><p>{0} long text goes here and on</p><p>and on {0}</p></div></div><div class=sidebar>links</div></body>"
    got = extracted(spark, [(i, "http://d.example/", body.format(i)) for i in range(3)])
    assert got[1] == "1 long text goes here and on and on 1"


def test_edge_cases(spark):
    cut = page("T", ["a", "b"]).split("</article>")[0] + "</article><footer></footer>"
    deep = "<div>" * 5000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "x", ""), (3, "not a url", "no tags & at all"), (4, "https://e.example", cut), (5, "https://e.example", "<p>a<p>b<li>c"), (6, "http://f.example", deep), (7, "https://g.example", "<article><p>" + "w " * 300_000), (4, "https://e.example", cut), (8, "http://h.example", '<article title="a>b" <p>x<!-- open')]
    got = extracted(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "no tags & at all" and got[4] == "T a b" and got[6] == "deep"
    assert got[5] == "a b c" and got[7] == " ".join(["w"] * 300_000)
    assert H.main_text(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapper_is_a_union_free_expression():
    trees = [H.parse(f"<article><h1>t</h1>{'<p>x</p>' * n}{'<figure>f</figure>' if n == 2 else ''}<ul><li>a</li></ul></article>") for n in (1, 2, 4)]
    whole = H.page_wrapper(trees[0])
    for t in trees[1:]:
        whole = H.merge(whole, H.page_wrapper(t))
    assert H.expression(whole) == "<article><h1>#text</>(<p>#text</>)+(<figure>#text</>)?<ul><li>#text</></></>"


def test_query_against_the_articles(spark, tables):
    import html

    rows = spark.read.parquet(f"{tables}/pages.parquet").collect()
    got = {r.page_id: r for r in H.op8_main_text(spark, tables).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))
        assert got[r.page_id].text == " ".join(html.unescape(inner).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("url, host", [("https://A.b/c", "a.b"), ("http://u@x.y:80?q", "x.y"), ("nothing", ""), (None, "")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(H.host_of("u").alias("h")).first().h == host
