"""Main text of hand-made pages, of a host with a template, and of broken markup."""

from tickweave.llm import html_text
from tickweave.llm.html_text import extract, main_text, match, parse, skeleton


def text(html):
    return main_text(parse(html), set())


def test_article_without_chrome():
    html = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Top</header><nav><a>Menu</a></nav>
    <article><h1>Head &amp; line</h1><p>One <b>bold</b>&nbsp;word<br>more</p><p><b>open<br><p>Next&copy</p><aside>side</aside><form><p>form</p></form>
    <ul><li>a<li>b</ul><div class="ad">Buy</div><section class="comments"><p>first!</p></section><table><tr><td>c1<td>c2</table></article>
    <div id="sidebar">x</div><footer>f</footer></body></html>"""
    assert text(html).split("\n") == ["Head & line", "One bold word more", "open", "Next©", "a", "b", "c1", "c2"]


def test_broken_and_odd_markup():
    assert text("") == "" and text("just words") == "just words"
    assert text("<p>a<p>b</i></p></div>c") == "a\nb\nc"
    assert text("<article><p>x <!-- never closed") == "x"
    assert text("<article><p>1 < 2 &#x41;&#66; &unknown; &amp</p></article>") == "1 < 2 AB &unknown; &"
    assert text("<article><script>if(a<b){}</article>") == ""
    assert text('<article><p title="a>b">t</p><p hidden>h</p><math><mi>x</mi></math><noscript>n</noscript></article>') == "t\nh\nxn"  # nothing is dropped for not being shown
    assert text("<ARTICLE><P>Up</P></ARTICLE>") == "Up"


def test_matching_keeps_order_and_finds_equal_texts():
    a = parse("<body><div><p>same</p><p>one</p></div></body>")
    b = parse("<body><div><p>new</p><p>same</p><p>two</p></div></body>")
    pairs = []
    assert match(skeleton(a), b, pairs) > 0
    assert ("same" in [n.text for i, n in pairs if i == 0]) and len(pairs) == 2
    assert match(skeleton(a), parse("<body></body>")) < match(skeleton(a), a)


def test_template_of_a_host_without_article(spark):
    page = '<html><body><div class="x"><p>Welcome to our site</p></div><div class="y"><p>Story {0} begins here and goes on</p><p>It has part {0} too</p></div><div class="z"><p>All pages say this</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)] + [(100, "http://other.example/", page.format(100)), (101, None, None), (None, "no host", "<p>z</p>"), (7, "http://h.example/7", page.format(7))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as reference", "3 as text", "4 as n_chars")
    got = [tuple(r) for r in extract(df).collect()]
    assert len(got) == len(rows)
    want = "Story {0} begins here and goes on\nIt has part {0} too"
    for i in range(8):
        assert (i, f"http://h.example/{i}", want.format(i), len(want.format(i))) in got
    assert (101, None, "", 0) in got and (None, "no host", "z", 1) in got
    assert next(r for r in got if r[0] == 100)[2].startswith("Welcome")  # one page shows no template
    assert extract(df.limit(0)).collect() == []


def test_shared_lines_inside_an_article_stay(spark):
    page = "<html><body><nav>m</nav><article><h1>T{0}</h1><p>The same line everywhere.</p><p>Own {0}</p></article><footer>f</footer></body></html>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(9)], "page_id bigint, url string, html string")
    assert {r["text"] for r in extract(df).collect()} == {f"T{i}\nThe same line everywhere.\nOwn {i}" for i in range(9)}


def test_every_varying_block_is_kept():
    assert text("<body><div><h1>title</h1><div>" + "lead " * 30 + "</div><div>" + "body " * 65 + "</div></div></body>").split("\n") == ["title", ("lead " * 30).strip(), ("body " * 65).strip()]
    page = '<main><p>intro</p><article><p>one</p></article><article><p>two is longer</p></article><article class="comment"><p>first!</p></article></main>'
    assert text(page) == "intro\none\ntwo is longer"


def test_thousands_of_unclosed_tags():
    root = parse("<body><p>a</p>" + "<font>" * 5000 + "deep" + "<span>" * 5000 + "er")
    pairs = []
    assert main_text(root, set()) == "a\ndeeper" and match(skeleton(root), root, pairs) > 10000 and len(pairs) == 3


def test_template_is_learnt_from_many_layouts_and_whole_pages(spark):
    body = "".join("<p>Part %d of {0} goes on</p>" % k for k in range(450))
    long_page = "<html><body><div>" + body + "<p>Constant in the middle</p>" + body + "</div><div><p>All rights at the end</p></div></body></html>"
    notice = '<html><body><div class="n"><p>We are moving house</p></div><div class="t"><p>Short {0} text</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", long_page.format(f"story{i}")) for i in range(12)] + [(100 + i, f"http://h.example/{i}", notice.format(i)) for i in range(9)]
    rows += [(200 + i, f"http://h.example/e{i}", h) for i, h in enumerate([None, "", " "] * 12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for i in range(9):
        assert got[100 + i] == f"Short {i} text"
    for i in range(12):
        assert "All rights" not in got[i] and "Constant in the middle" not in got[i] and got[i].count("\n") == 899


def test_attributes_without_quotes_may_hold_apostrophes():
    assert text("<article><p title=it's>hello world</p><p>don't</p></article>") == "hello world\ndon't"
    assert text("<article><p title='a>b' x=\"c>d\" y = 'e>f'>t</p></article>") == "t"


def test_paragraphs_of_an_article_are_not_taken_for_chrome():
    words = "legal share tags follow header search related copyright".split()
    page = "<article>" + "".join(f'<p class="{w}">{w} text</p>' for w in words) + '<div class="ad-slot">buy</div><span aria-hidden="true">seen</span></article><p class="share">out</p>'
    assert text(page).split("\n") == [f"{w} text" for w in words] + ["seen"]


def test_alignment_decides_inside_articles(spark):
    page = "<html><body><article><h1>Title {0}</h1><div><p>" + "Own words of {0} go on and on. " * 9 + "</p></div><p>Written for our readers</p><p>Closing words of {0}</p></article></body></html>"
    html = [page.format(f"story{i}") for i in range(9)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    with_template = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for i, h in enumerate(html):
        without = text(h)
        assert "Written for our readers" in without
        assert with_template[i] == without.replace("\nWritten for our readers", "")


def test_copies_of_one_article_stay_whole(spark):
    page = "<html><body><div class='t{0}'><p>{0}</p></div><article><h1>Title</h1><p>" + "The same words in all copies. " * 9 + "</p><p>Changed {0}</p></article></body></html>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(9)], "page_id bigint, url string, html string")
    assert all("The same words" in r["text"] and "Title" in r["text"] for r in extract(df).collect())


def test_ten_thousand_nested_elements():
    assert text("<div>" * 10_000 + "deep" + "</div>" * 10_000) == "deep"


def test_wrappers_named_after_chrome_keep_their_article():
    for start, end in (('<div class="page has-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="page-with-footer">', "</div>"), ('<div class="nav-open">', "</div>"), ('<div id="header-2" class="with-share">', "</div>"), ('<div class="sidebar">', "</div>"), ('<div class="widget"><form>', "</form></div>")):
        for tag in ("article", "main"):
            assert text(f"<body><nav>menu</nav>{start}<aside><article>teaser</article></aside><{tag}><p>Text</p><form>f</form></{tag}><div class='footer'>x</div>{end}</body>") == "Text", (start, tag)
    assert text('<body><form id="aspnetForm"><div class="menu"><a>a</a></div><p>' + "A story. " * 20 + "</p></form></body>") == ("A story. " * 20).strip()
    assert text('<body><nav><a>menu</a></nav><footer>foot</footer></body>') == ""


def test_compounds_that_only_speak_of_chrome():
    kept = "notice-of-death advert-law modal-verbs subscribe-economy share-price search-for-gold post-header".split()
    for inside in ("<article>%s</article>", "<body>%s</body>"):
        assert text(inside % "".join(f'<div class="{c}">{c}</div>' for c in kept)).split("\n") == kept
    assert text('<article><div class="left-sidebar">x</div><div class="cookieNotice">x</div><div class="comments-list">x</div><p>t</p></article><div class="site-header">x</div>') == "t"


def test_a_notice_that_repeats_in_articles_of_any_length(spark):
    for n in (6, 40, 400):
        page = "<html><body><article><h1>Title {0}</h1>" + "".join("<p>Paragraph %d of {0} tells its own story</p>" % k + ("<p>Please note our terms</p>" if k in (2, n // 2) else "") for k in range(n)) + "</article></body></html>"
        df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(f"story{i}")) for i in range(8)], "page_id bigint, url string, html string")
        for r in extract(df).collect():
            assert "Please note" not in r["text"] and r["text"].count("\n") == n


def brute_size(a, b):
    """Simple tree matching as it is defined, over whole lists of children."""
    if a.label != b.label:
        return 0
    if a.tag == "#text":
        return 3 if a.hash() == b.hash() else 2
    x, y = a.solid(), b.solid()
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_size(u, v))
    return 2 + best[-1][-1]


def test_matching_equals_brute_force_on_small_trees():
    import random

    rng = random.Random(9)

    def some(depth):
        return "".join(rng.choice(["one", "two", "<br>"]) if depth == 0 or rng.random() < 0.3 else f"<{t}>{some(depth - 1)}</{t}>" for t in rng.choices(["p", "div", "ul", "b"], k=rng.randint(1, 4)))

    for _ in range(60):
        a, b = parse(some(3)), parse(some(3))
        assert match(skeleton(a), b) == brute_size(a, b)


def test_matching_equals_brute_force_on_long_lists():
    """The largest matching whatever the lengths: lists in another order, with equal texts, of other labels."""
    import random

    rng = random.Random(4)

    def some(n):
        return "".join(rng.choice([f"<p>{rng.randrange(30)}</p>", f"<div><b>{rng.randrange(9)}</b> {rng.randrange(40)}</div>", "<ul><li>same</li></ul>"]) for _ in range(n))

    for n in (25, 60, 150):
        for _ in range(3):
            a, b, pairs = parse(some(n)), parse(some(n + 7)), []
            assert match(skeleton(a), b, pairs) == brute_size(a, b)
            places = {id(node): i for i, node in enumerate(n for n in html_text._below(b) if n.tag == "#text")}
            assert len(pairs) == len({i for i, _ in pairs}) == len({places[id(node)] for _, node in pairs})


def test_page_of_a_megabyte():
    page = "<article>" + "".join(f"<p>paragraph {i} <b>bold</b> text</p>" for i in range(30_000)) + "</article>"
    root = parse(page)
    assert len(page) > 1_000_000 and main_text(root, set()).count("\n") == 29_999 and match(skeleton(root), parse(page)) > 60_000
