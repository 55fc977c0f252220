import html as h
import random

from quillspark.llm import dom
from quillspark.llm import html_extract as op


def page(body, head="<title>t</title><style>p{}</style><script>var a='</p>'</script>"):
    return f"<!DOCTYPE html><html lang='en'><head>{head}</head><body>{body}</body></html>"


def text(body, template=None):
    return op.extract(page(body), template)


def test_article_without_its_surroundings():
    body = (
        "<header><a>Site</a></header><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div><div class='ad'>Buy</div>"
        "<article><header><h1>A &amp; B</h1></header><p>One <b>two</b>\n  three<p>Four&nbsp;five<br>six</p><ul><li>x<li>y</ul>"
        "<div class='share-buttons'>Share</div><form>Name <input></form><section id='comments'><p>first!</p></section></article>"
        "<aside>side</aside><div id='sidebar'><p>more</p></div><section class='comments'><article class='comment'><p>nice</p></article></section><footer>© x</footer>"
    )
    assert text(body) == "A & B\nOne two three\nFour five\nsix\nx\ny"


def test_names_that_only_tell_about_an_element():
    assert text("<article class='post ad-free'><p>a</p></article>") == "a"
    assert text("<div class='content has-sidebar no-ads'><h1>t</h1><p>a b c</p></div><div class='ads'>x</div>") == "t\na b c"
    assert text("<article><p>long text here</p></article><article class='comment'>c</article>") == "long text here"


def test_broken_markup():
    assert text("<article><p><b>Bold.<br><p>Next < 3 & more</p><p title='a>b'>q</article>") == "Bold.\nNext < 3 & more\nq"
    assert text("<main><table><tr><td>a<td>b<tr><td>c</table></main>") == "a\nb\nc"
    assert op.extract("", None) == op.extract(None, None) == ""
    assert op.extract("no markup at all", None) == "no markup at all"
    assert op.extract("<article>" + "<p>x" * 5000, None).count("x") == 5000
    assert op.extract("<" * 2000 + "<!--" + "<script>", None) == "<" * 2000


def test_deep_nesting_is_read():
    for n in (100, 400, 5000):
        assert op.extract(f"<article>{'<div>' * n}core{'</div>' * n}</article>", None) == "core"
    assert op.extract("<article>" + "<span>x " * 3000, None).split() == ["x"] * 3000


def test_menus_below_the_last_level_are_left_out():
    """However deep, roles count and blocks end lines."""
    for n in (150, 198, 199, 200, 201, 400, 3000):
        body = "<article>" + "<div>" * n + "<nav><b>MENU</b><div>x</div></nav><p>one</p><p>two <b>b</b></p><ul><li>x<li>y</ul><div class='ads'>buy</div>" + "</div>" * n + "<p>after</p></article>"
        assert op.extract(body, None) == "one\ntwo b\nx\ny\nafter"


def test_names_whose_other_words_matter():
    for name in ("social-science", "cookie-recipes", "menu-of-the-king", "bannerman"):
        assert text(f"<main><div class='{name}'><p>a</p></div></main>") == "a"
    for name in ("social-links", "main-nav", "cookieBanner", "widget-area", "related-posts", "site-footer sidebar-left"):
        assert text(f"<main><p>a</p><div class='{name}'><p>x</p></div></main>") == "a"


def test_a_page_within_a_form():
    assert text("<form action='x'><h1>T</h1><p>All of it stands here.</p><input><select><option>o</select></form>") == "T\nAll of it stands here."
    assert text("<p>core</p><form><p>Your mail</p><input></form>") == "core"


def test_the_template_decides_where_nothing_has_a_name(spark):
    """Pages of bare divs: without the template the head and foot of the site stay; whatever the order, the result is the same."""
    def make(k):
        return page(f"<div><div>My site</div><div>All about stones</div></div><div><h2>Title {k}</h2><p>Words of {k} that differ.</p><p>{'Rare remark.' if k == 7 else f'Tail {k}.'}</p></div><div>All rights reserved</div>")

    rows = [(k, f"http://h.x/{k}", make(k)) for k in range(40)] + [(100, "http://other.x/1", make(100))]
    want = {k: f"Title {k}\nWords of {k} that differ.\n" + ("Rare remark." if k == 7 else f"Tail {k}.") for k in range(40)}
    for seed, parts in ((1, 1), (2, 3), (3, 7)):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        got = {r["page_id"]: r["text"] for r in op.extract_main_text(spark.createDataFrame(mixed, "page_id long, url string, html string").repartition(parts)).collect()}
        assert {k: got[k] for k in want} == want
        assert "My site" in got[100]  # a host of one page has no template


def test_constant_texts_are_counted_exactly(spark):
    """79 and 80 of 100 pages have a text, in any order of merging."""
    for n, constant in ((79, False), (80, True)):
        rows = [(k, f"http://h.x/{k}", page(f"<div>{'Read our news' if k < n else f'Other {k}'}</div><div><h2>Title {k}</h2><p>Words of {k} that differ a lot from page to page.</p></div><div>All rights reserved</div>")) for k in range(100)]
        random.Random(n).shuffle(rows)
        got = op.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
        with_it = sum("Read our news" in r["text"] for r in got)
        assert with_it == (0 if constant else n) and sum("Other" in r["text"] for r in got) == 100 - n


def test_slots_of_a_template_are_content():
    def make(k):
        return page(f"<div class='top'>My site</div><div class='body'><h2>Title {k}</h2><p>Words of {k} that differ.</p><p>Always here.</p><p>Tail {k}.</p></div><div class='foot'>All rights reserved</div>")

    tree = op.Slot.load(op.learned([make(k) for k in range(8)]).dump())
    assert op.extract(make(99), tree) == "Title 99\nWords of 99 that differ.\nTail 99."
    assert op.extract(make(99), None) != op.extract(make(99), tree)


def test_matching_keeps_order():
    a = op.condense(dom.parse("<ul></ul><p>x</p><div></div>"))
    b = op.condense(dom.parse("<div></div><p>y</p><ul></ul>"))
    assert op.matching(a, a) == 4 and op.matching(a, b) == 2
    m = op.merge(a, b)
    assert len(m.children) == 5  # one of the three is paired


def article_of(page_html):
    """The generator's pages: blocks of the article element."""
    import re

    a = re.search("<article>(.*?)</article>", page_html, re.S)[1]
    blocks = (" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", a))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").repartition(5)
    want = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    got = op.extract_main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, "http://a.x/1", page("<article><p>a</p></article>"), 1), (1, "http://a.x/1", page("<article><p>a</p></article>"), 1), (2, None, None, 2), (3, "::bad", "", 3), (None, "http://A.X:80/2", page("<p>b</p>"), 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    want = [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0), (None, "b", 1)]
    for most in (op.BROADCAST_BYTES, 0):  # joined templates give the same
        monkeypatch.setattr(op, "BROADCAST_BYTES", most)
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in op.extract_main_text(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert op.extract_main_text(df.limit(0)).count() == 0


def test_the_template_decides_inside_articles():
    def make(k):
        return page(f"<article><h1>Title {k}</h1><div class='box'>Get our letter every week</div><p>Words of {k} that differ from page to page.</p></article>")

    tree = op.learned([make(k) for k in range(8)])
    assert op.extract(make(99), tree) == "Title 99\nWords of 99 that differ from page to page."
    same = page("<article><h1>One</h1><p>An article that the host repeats.</p></article>")
    assert op.extract(same, op.learned([same] * 8)) == "One\nAn article that the host repeats."


def test_all_articles_stay_in_page_order():
    assert text("<article><p>" + "a" * 60 + "</p></article><article><p>" + "b" * 40 + "</p></article>") == "a" * 60 + "\n" + "b" * 40


def test_text_other_than_the_constant_one_stays():
    def make(k, lead="Nothing new today"):
        return page(f"<div class='lead'>{lead}</div><div class='body'><h2>T {k}</h2><p>Words of {k}.</p><p>More of {k}.</p></div>")

    tree = op.learned([make(k) for k in range(10)])
    assert op.extract(make(99), tree) == "T 99\nWords of 99.\nMore of 99."
    lead = "A long lead that stands on this page alone and tells what happened"
    assert op.extract(make(99, lead), tree) == f"{lead}\nT 99\nWords of 99.\nMore of 99."
    assert op.extract(make(99, "Nothing new today<b>but this</b>"), tree).startswith("Nothing new todaybut this")


def test_an_article_is_never_lost_by_its_class():
    assert text("<header>Site</header><article class='news alert'><h1>T</h1><p>The whole story.</p></article><footer>x</footer>") == "T\nThe whole story."
    assert text("<aside class='sidebar'><p>s</p></aside><div class='sidebar content'><article><p>The whole story stands here.</p></article></div>") == "The whole story stands here."


def test_articles_in_other_parts_are_not_the_page_s():
    own = "<article><h1>T</h1><p>Own text.</p></article>"
    for other in ("<aside><article><p>Foreign and much longer than the own text.</p></article></aside>", "<section class='related'><article><h2>Teaser</h2></article></section>", "<section id='comments'><article><p>I disagree.</p></article></section>", "<div role='complementary'><article>x</article></div>"):
        assert text(own + other) == text(other + own) == "T\nOwn text."


def test_telling_words_beside_others():
    for name in ("reader-comments", "comment-thread", "disqus_thread", "cookie-message", "newsletter-cta", "js-cookieBar"):
        assert text(f"<article><p>Own text of some length.</p><div class='{name}'><p>x</p></div></article>") == "Own text of some length."
    assert text("<article><div class='cookie-kitchen'><p>Butter, sugar and flour.</p></div><p>Bake.</p></article>") == "Butter, sugar and flour.\nBake."


def brute_matching(a, b):
    """The most pairs, by trying every order-keeping choice of children."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute_matching(x[0], y[0]) + best(x[1:], y[1:]) if x[0].label == y[0].label else 0)

    return 1 + best(a.children, b.children)


def test_matching_equals_brute_force():
    rng = random.Random(4)

    def tree(depth):
        return op.Slot(rng.choice("ab"), None, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    for _ in range(300):
        a, b = tree(3), tree(3)
        assert op.matching(a, b) == brute_matching(a, b)


def test_a_host_of_generated_layouts_stays_small():
    """However many different blocks come and go, the template keeps what is common and little else."""
    import time

    def layout(k):
        rng = random.Random(k)
        blocks = "".join(f"<div class='{''.join(rng.choices('bcdfghjklm', k=9))}'><p>w{k}</p></div>" for _ in range(10))
        return page(f"<div class='head'><p>Site</p></div>{blocks}<div class='foot'><p>Rights</p></div>")

    def nodes(t):
        return 1 + sum(map(nodes, t.children))

    took, sizes, template = [], [], None
    for k in range(1200):
        start = time.process_time()
        tree = op._bare(op.condense(op.parse(layout(k), op.is_apart)))
        template = op.grown(template, tree) if template else tree
        took.append(time.process_time() - start)
        sizes.append(nodes(template))
    assert max(sizes) < 40 * 30 and sizes[-1] < 1.5 * max(sizes[:400])
    assert sum(took[-300:]) < 3 * sum(took[300:600]) + 0.5
    labels = [c.label for c in op.numbered(template)]
    assert "div.head" in " ".join(labels) and "div.foot" in " ".join(labels)
