import re

from pointprep.llm import html_wrappers as hw

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><script>var a = "</p><article>no</article>";</script></head><body>
<header class="site">Site name</header><nav><ul>{menu}</ul></nav><div class="cookie-notice"><p>We use cookies<div>ok</div></div>
<article><h1>Title {n}</h1>{body}<div class="comments"><p>First!</p></div></article>
<aside><p>Popular</p></aside><form><label>Mail</label></form><!-- hidden <p>x</p> --><footer>&copy; 2024</footer></body></html>"""


def page(n, body, menu="<li><a>Home</a></li><li><a>News</a></li>"):
    return PAGE.format(n=n, body=body, menu=menu)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, wrapper string")


def test_main_text(spark):
    rows = [
        (1, "https://a.example/1", page(1, "<p>One <b>bold</b>&amp; more.<br>Line</p><p>Two\n  words</p>")),
        (2, "https://a.example/2", page(2, "<p>Three")),
        (3, "https://A.example/3?x", page(3, "<p>x</p>" * 300, "")),
        (4, "https://b.example/", "no markup at all & more"),
        (5, None, None), (6, "", ""), (7, "https://a.example/7", page(7, "<ul><li>a<li>b</ul><p>&lt;tag&gt; &#233;&nbsp;&#x4e2d;</p>")),
        (7, "https://a.example/7", page(7, "<ul><li>a<li>b</ul><p>&lt;tag&gt; &#233;&nbsp;&#x4e2d;</p>")),
    ]
    got = {r["page_id"]: r for r in hw.extract_main_text(table(spark, rows)).collect()}
    assert hw.extract_main_text(table(spark, rows)).count() == len(rows)
    assert got[1]["text"] == "Title 1\n\nOne bold& more. Line\n\nTwo words"
    assert got[2]["text"] == "Title 2\n\nThree"
    assert got[3]["text"] == "\n\n".join(["Title 3"] + ["x"] * 300)
    assert got[4]["text"] == "no markup at all & more"
    assert got[5]["text"] == got[6]["text"] == "" and got[5]["url"] is None
    assert got[7]["text"] == "Title 7\n\na\n\nb\n\n<tag> é 中"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert hw.extract_main_text(table(spark, [])).count() == 0


def test_wrapper_is_union_free_with_optional_and_repeated_parts():
    w = hw.infer([page(1, "<p>a</p><p>b</p><p>c</p>"), page(2, "<p>a</p>"), page(3, "<h2>s</h2><p>a</p><p>b</p>", "")])
    shown = hw.expression(w)
    assert "(<p>#</p>)+" in shown and "(<li><a>#</a></li>)+?" in shown and "<h2>?" in shown and "|" not in shown


def test_pages_without_article_use_the_wrapper(spark):
    def plain(n):
        return f"<html><body><div class='top'>Same banner text</div><div><p>Text {n} here</p></div><div>Same end</div></body></html>"

    rows = [(i, "http://c.example/", plain(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in hw.extract_main_text(table(spark, rows)).collect()}
    assert got == {i: f"Text {i} here" for i in range(6)}


def test_whole_table_against_the_plain_rule(spark):
    import html as h

    def plain(p):
        a = p[p.index("<article>") + 9: p.index("</article>")]
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", a)]
        return "\n\n".join(b for b in blocks if b)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in hw.extract_main_text(pages).collect()} == want


def test_every_template_of_a_large_host_is_in_its_wrapper(spark):
    """30 templates on one host with 10 pages each: banners and ends of all of them go, whichever pages come first."""

    def page_of(t, n):
        return f"<html><body><div class='b{t}'>Banner {t}</div><div><p>Text {t} of {n}</p></div><h{1 + t % 5}>End {t}</h{1 + t % 5}></body></html>"

    rows = [(100 * t + n, "http://d.example/", page_of(t, n)) for t in range(30) for n in range(10)]
    got = {r["page_id"]: r["text"] for r in hw.extract_main_text(table(spark, rows).repartition(7)).collect()}
    assert got == {100 * t + n: f"Text {t} of {n}" for t in range(30) for n in range(10)}


def test_copies_of_a_page_do_not_make_its_text_fixed(spark):
    rows = [(i, "http://e.example/", "<html><body><div>All the same</div></body></html>") for i in range(9)]
    assert {r["text"] for r in hw.extract_main_text(table(spark, rows)).collect()} == {"All the same"}


def test_hosts_with_and_without_articles(spark):
    plain = [(i, "http://f.example/", f"<html><body><div>Same top</div><div><p>Plain {i}</p></div></body></html>") for i in range(5)]
    rows = plain + [(10 + i, "http://f.example/", page(i, f"<p>Body {i}</p>")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in hw.extract_main_text(table(spark, rows)).collect()}
    assert got == {i: f"Plain {i}" for i in range(5)} | {10 + i: f"Title {i}\n\nBody {i}" for i in range(5)}


def test_the_wrapper_decides_within_articles(spark):
    """Every page has an article: what repeats in it goes, and a block that only a class word marks stays if its text varies."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = []
    for r in pages.orderBy("page_id").collect():
        a, b = r["html"].split("</article>", 1)
        extra = f"<div class='search-notice'>Summary of {r['page_id']}</div><div class='end'>Subscribe today</div><div class='share'><a>Post</a></div>"
        rows.append((r["page_id"], "http://g.example/", f"{a}{extra}</article>{b}"))
    before = {r["page_id"]: r["text"] for r in hw.extract_main_text(pages).collect()}
    got = {r["page_id"]: r["text"] for r in hw.extract_main_text(table(spark, rows)).collect()}
    assert got == {k: f"{t}\n\nSummary of {k}" for k, t in before.items()}


def test_comments_that_vary_are_not_the_body():
    def own(n):
        return page(n, f"<p>One {n}</p><p>Two {n}</p>").replace("<p>First!</p>", f"<p>Comment {n}</p><p>More {n}</p>")

    w = hw.infer([own(n) for n in range(6)])
    assert [hw.extract(own(n), w) for n in range(6)] == [f"Title {n}\n\nOne {n}\n\nTwo {n}" for n in range(6)]
