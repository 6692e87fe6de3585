"""Main text of small pages, and the alignment of their lines."""

from __future__ import annotations

import random
import time

from millrace.llm import html_text
from millrace.llm.html_text import aligned_lines, article, main_texts, read_page, shared_lines


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            same = best[i][j] + 1 if a[i] == b[j] else 0
            best[i + 1][j + 1] = max(same, best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = shared_lines(a, b)
        assert len(places) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(places))


def test_what_a_page_marks_as_no_article_goes():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="search">
    <header>H</header><nav><ul><li>menu</li></ul></nav><div class="cookie-notice">Cookies!</div>
    <article><header><h1>Title &amp; more</h1></header><p>One  <b>two</b>\n three<br>four &lt;5 &#233;</p>
    <aside>side</aside><script>var t="</p>";</script><div class="ad">buy</div><p>five<!-- x > y -->six
    <section id="comments"><p>first!</p></section><form>f<input></form></article>
    <footer>&copy;</footer></body></html>"""
    assert article(read_page(html), []) == "Title & more\nOne two three\nfour <5 é\nfivesix"


def test_a_left_out_paragraph_needs_no_end_tag():
    html = '<article><p>one<p class="notice">gone<p>two</article>'
    assert article(read_page(html), []) == "one\ntwo"


def test_pages_without_an_article_lose_the_lines_of_their_neighbours(spark):
    def page(k):
        return f"<body><div>Site name</div><p>Text {k} a</p><p>Text {k} b</p><div>All rights</div></body>"

    rows = [(k, f"http://h.example/a/{k}", page(k)) for k in range(4)]
    rows += [(10, "http://alone.example/", page(10)), (11, None, None), (12, "http://x.example/", "")]
    rows += [(13, "http://copy.example/1", page(1)), (14, "http://copy.example/2", page(1)), rows[0]]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    found = [(r.page_id, r.text) for r in main_texts(table.coalesce(1)).collect()]
    assert sorted(i for i, _ in found) == sorted(r[0] for r in rows)
    texts = dict(found)
    assert all(texts[k] == f"Text {k} a\nText {k} b" for k in range(1, 4))
    whole = "Site name\nText {0} a\nText {0} b\nAll rights".format
    assert texts[10] == whole(10) and texts[11] == "" and texts[12] == ""
    assert texts[13] == texts[14] == whole(1)


def test_names_around_and_in_an_article_do_not_drop_it():
    names = ("layout has-sidebar", "no-sidebar", "with-comments", "page-search", "search-page", "sidebar")
    for name in names:
        for tag in ("article", "main"):
            html = f"<body><div class='{name}'><nav>N</nav><{tag}><p>text</p></{tag}></div><p>after</p></body>"
            assert article(read_page(html), []) == "text"
    for name in names[:3]:
        assert article(read_page(f"<div class='{name}'><p>text</p></div>"), []) == "text"
    html = """<article><section class="discussion">a</section><section id="related">b</section><label>c</label>
    <p>let <math><mi>x</mi></math></p><dialog open>d</dialog><dialog>e</dialog><div class="cookie-bar">f</div>
    </article><section class="comments"><article>first!</article>
    <article>second!</article></section><div class="related">g</div>"""
    assert article(read_page(html), []) == "a\nb\nc\nlet\nx\nd"


def site(k):
    """A short article in a long template."""
    menu = "".join(f"<div>Entry {n} of the menu of this site, as on all pages</div>" for n in range(40))
    return f"<body>{menu}<p>{unlike(k)}</p><div>All rights of this site</div></body>"


def unlike(k):
    return " ".join(random.Random(k).choices([f"w{n}" for n in range(500)], k=60))


def test_a_long_template_around_short_articles_goes():
    pages = [read_page(site(k)) for k in range(3)]
    empty = read_page(site(0).replace(unlike(0), ""))
    assert article(pages[0], pages[1:]) == unlike(0)
    assert article(pages[0], pages[1:2]) == unlike(0)
    assert article(pages[0], [empty]) == unlike(0)


def test_edited_copies_keep_their_text():
    text = [unlike(k) for k in range(20)]
    words = text[3].split()
    words[7] = "other"
    first, second = (
        read_page("".join(f"<p>{t}</p>" for t in x)) for x in (text, [*text[:3], " ".join(words), *text[4:]])
    )
    assert article(first, [second]) == "\n".join(text)


def test_lines_that_recur_inside_marked_articles_go():
    def wrapped(k):
        return read_page(f"<body><main><div class='x1'>A B C</div><p>{unlike(k)}</p><div>Buy now</div></main></body>")

    pages = [wrapped(k) for k in range(3)]
    assert article(pages[0], pages[1:]) == unlike(0)
    # One page alone may quote the article.
    assert article(pages[0], pages[1:2]) == f"A B C\n{unlike(0)}\nBuy now"
    copies = [read_page(f"<article><p>{unlike(1)}</p><p>{unlike(2)}</p><p>Seen {k}</p></article>") for k in range(3)]
    assert article(copies[0], copies[1:]) == f"{unlike(1)}\n{unlike(2)}\nSeen 0"


def test_equal_pages_do_not_hide_other_neighbours(spark):
    """Copies on both sides, repeated rows, hosts cut over tasks: any cut gives the same texts."""
    rows = [(k, f"http://h.example/a/{k // 10:03}/{k}", site(k // 10)) for k in range(60)]
    rows += [(100, "http://two.example/1", site(100)), (101, "http://two.example/2", site(101))]
    rows += [rows[0], rows[0], (200, "http://z.example/", site(200))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for stretches in (1, 7, 40):
        found = main_texts(table, stretches).collect()
        assert sorted(r.page_id for r in found) == sorted(r[0] for r in rows)
        for r in found:
            if r.page_id < 60:
                assert r.text == unlike(r.page_id // 10)
            elif r.page_id < 200:
                assert r.text == unlike(r.page_id)


def hosted(bodies):
    return [(k, f"http://h.example/a/{k:03}", f"<body><article>{body}</article></body>") for k, body in enumerate(bodies)]


def texts_of(spark, rows, stretches=None):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in main_texts(table.repartition(3), stretches).collect()}


def test_a_line_has_one_fate_on_a_host(spark):
    """A sentence that stands in three neighbours of thirty is text; one on most pages is template."""
    bodies = [
        f"<p>{unlike(k)}</p>" + ("<p>A quoted sentence.</p>" if k in (4, 5, 6, 20) else "")
        + ("<div>Seen on our site</div>" if k % 5 else "")
        for k in range(30)
    ]
    for stretches in (1, 9):
        texts = texts_of(spark, hosted(bodies), stretches)
        for k in range(30):
            quoted = "\nA quoted sentence." if k in (4, 5, 6, 20) else ""
            assert texts[k] == unlike(k) + quoted


def test_headlines_that_neighbours_share_stay(spark):
    bodies = [f"<h1>Daily report</h1><p>{unlike(k)}</p><p>Daily report</p>" for k in range(12)]
    texts = texts_of(spark, hosted(bodies))
    assert all(texts[k] == f"Daily report\n{unlike(k)}" for k in range(12))


def test_long_odd_pages_take_no_time():
    """A megabyte of open quotes, of one attribute, and a hundred thousand equal lines."""
    began = time.process_time()
    assert read_page("<a \"x " * 160_000).lines
    assert read_page("<p>" + "<a b=\"x ' <p c='\" " * 50_000 + "><b>y</b>") is not None
    assert read_page("<p>a<a " + "x" * 1_000_000 + ">y").lines == ["ay"]
    one, two = read_page("<p>x</p>" * 100_000), read_page("<p>x</p>" * 90_000 + "<p>y</p>")
    assert len(shared_lines(one.lines, two.lines)) == 90_000
    assert time.process_time() - began < 20


def test_alignments_cut_in_two_are_as_long(monkeypatch):
    rng = random.Random(5)
    whole = [([rng.choice("abc") for _ in range(60)], [rng.choice("abcd") for _ in range(50)]) for _ in range(40)]
    wanted = [len(shared_lines(a, b)) for a, b in whole]
    monkeypatch.setattr(html_text, "ROW_BITS", 40)
    for (a, b), n in zip(whole, wanted, strict=True):
        pairs = sorted(aligned_lines(a, b))
        assert len(pairs) == n and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_quotes_in_tags():
    assert read_page("<p>a<a title='x > y' href=z>b</a> <i class=\"q\">c</i>").lines == ["ab c"]
    assert read_page("<p it's>a</p><p>b").lines == ["a", "b"]
    assert read_page("a < b <3 c<br/>d").lines == ["a < b <3 c", "d"]


def test_empty_table(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_texts(table).count() == 0
