"""Main texts of pages whose articles are known."""

import random

import pytest

from tracewright.llm import templates

PAGE = "page_id long, url string, html string, text string, host string"


def extracted(spark, rows):
    df = templates.extract(spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGE))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    return {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in df.collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def blocks(rng, most=6):
    return [words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, most))]


MARKED = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>if (a<b) t="</article><p>no</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/{i}">{n}</a><li>{n}</ul></nav><div class="cookie-notice">We use <b>cookies</b> {n}</div>
<main><article class="post"><header><h1>{t}</h1></header>{b}<div class="ad-slot">Buy {n}</div><p>in<b>li</b>ne <span class="advert">{n}</span> text</p>
<aside>{n}</aside><form><label>Mail</label><input name=q></form><section id="comments"><article class="comment">{n}</article></section></article></main>
<div id=sidebar><p>{n}</p></div><footer>&copy; {n}</footer></body></html>"""

UNMARKED = """<html><head><title>{t}</title></head><body><div id="top"><div class="menu"><a href="/{i}">{n}</a></div></div>
<div id="wrap"><div id="c1"><ul><li><a href="/x">{n}</a></li><li><a href="/y">y</a></li></ul></div><div id="c2"><h1>{t}</h1>{b}<p>Read our magazine every day of the week</p></div></div>
<div id="bottom">All rights reserved</div></body></html>"""


def pages_of(rng, layout, host, n):
    rows, want = [], {}
    for i in range(n):
        title, body = words(rng, 4), blocks(rng)
        page = layout.format(t=title, b="".join(f"<p>{x}</p>" for x in body), n=words(rng, 3), i=i)
        rows.append((i, f"https://{host}/{i}", page))
        own = ["inline text"] if layout is MARKED else []
        want[i, f"https://{host}/{i}"] = "\n".join([title, *body, *own])
    return rows, want


def test_marked_and_unmarked_layouts(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for layout, host, n in ((MARKED, "marked.example", 6), (MARKED, "alone.example", 1), (UNMARKED, "deduced.example", 12)):
        r, w = pages_of(rng, layout, host, n)
        rows += r
        want |= w
    got = extracted(spark, rows)
    assert {k: v[0] for k, v in got.items()} == want and all(len(t) == n for t, n in got.values())


def test_blocks_of_the_template_in_an_article(spark):
    """Repeated blocks are the template's on many pages that differ, and the article's where pages are copies."""
    page = lambda x: f"<html><body><article><h1>{x}</h1><p>{x} {x} tells more</p><p>Follow us</p></article></body></html>"
    rows = [(i, f"http://many.example/{i}", page(f"title {i}")) for i in range(20)] + [(i, f"http://few.example/{i}", page(f"title {i}")) for i in range(3)] + [(i, f"http://copies.example/{i}", page("same")) for i in range(20)]
    got = {k: v[0] for k, v in extracted(spark, rows).items()}
    assert got[7, "http://many.example/7"] == "title 7\ntitle 7 title 7 tells more"
    assert got[1, "http://few.example/1"] == "title 1\ntitle 1 title 1 tells more\nFollow us"
    assert got[9, "http://copies.example/9"] == "same\nsame same tells more\nFollow us"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("no markup,\n  one   block &amp; &lt;p&gt;", "no markup, one block & <p>"),
        ("<article>a<!-- <p>b</p> -->c<br>d &eacute;&#233;&nbsp;e</article>", "ac d éé e"),
        ("<article><p><b>one<br><p>two</p>three</article><footer>x", "one\ntwo\nthree"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n f</pre></article>", "a\nb\nc\nd\ne f"),
        ("<article>a</b></i></div><p>b</article>c", "a\nb"),
        ("<article><p title='a > b'>x</p><p title=\"it's\">y</p><p class=z'>w</p></article>", "x\ny\nw"),
        ("<ARTICLE><P>Up</P><SCRIPT>x</SCRIPT></ARTICLE>", "Up"),
        ("<article>open <a href='x", "open"),
        ("<article><p>1 < 2 and a<b></p></article>", "1 < 2 and a"),
        ("<nav>only</nav><footer>this</footer>", ""),
        ("<form id=all><article><p>in a form</p><form>q</form></article></form>", "in a form"),
    ],
)
def test_markup(html, text):
    assert templates.article(templates.Page(html or ""), None) == text


def test_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 400_000 + "</p>" * 3 + "</article>"
    page = "<article><p>text</p></article>"
    rows = [(None, None, page), (1, None, None), (2, "", page), (2, "", page), (3, "no url", page), (4, "HTTP://user@Host.example:80/x", long), (5, "http://host.example", None)]
    df = templates.extract(spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGE))
    got = sorted(((r["page_id"], r["url"], r["text"][:9], r["n_chars"]) for r in df.collect()), key=repr)
    assert got == sorted([(None, None, "text", 4), (1, None, "", 0), (2, "", "text", 4), (2, "", "text", 4), (3, "no url", "text", 4), (4, "HTTP://user@Host.example:80/x", "word word", 5 * 400_000 - 1), (5, "http://host.example", "", 0)], key=repr)
    assert templates.extract(df.limit(0).withColumn("html", df["text"])).count() == 0


def test_many_hosts_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(templates, "MOST_HOSTS", 1)
    rng = random.Random(2)
    rows, want = pages_of(rng, MARKED, "a.example", 6)
    more, other = pages_of(rng, UNMARKED, "b.example", 9)
    assert {k: v[0] for k, v in extracted(spark, rows + more).items()} == want | other
