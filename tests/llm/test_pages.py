import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm.pages import extract, parsed, templates


def text(page):
    return parsed(page).without(set())


def test_the_article_is_what_remains():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/>menu</a></ul></nav>
    <div class="ad">buy</div><article><header>top</header><h1>T &amp; <i>U</i>V</h1><p>one<br>two &lt;x&gt; <script>if (a<b) "</p>"</script>three
    <p>four <b>fi<p>ve</b><aside>side</aside><form>f</form><ul><li>six<li>seven</ul><section class="comments"><p>c</section></article><footer>end"""
    assert text(page) == "T & UV one two <x> three four fi ve six seven"


def test_broken_pages():
    assert text(None) == text("") == text("<p") == text("<!-- x") == ""
    assert text("a < b <3 &am &amp") == "a < b <3 &am &"
    assert text("<div>" * 50_000 + "deep") == "deep"
    assert text("<p>a</p>\n b \u00a0 c<div>d</div>") == "a b c d"
    assert text("<main>m</main>rest") == "m"


def test_deep_and_long_broken_pages_take_little_time_and_memory():
    pages = ["<div>x" * 50_000, "<b>" * 40_000 + "</p>" * 40_000 + "z", "<p>" + "<div>" + "<i>" * 40_000 + "</p>" * 40_000 + "z", "<li>" * 40_000 + "</b>" * 40_000 + "z", "<article>" + "<section><p>t" * 30_000]
    tracemalloc.start()
    began = time.perf_counter()
    for page in pages:
        own = parsed(page)
        assert own.without({own.chain[0][0]} if own.chain else set()).count("x") == 0
    assert time.perf_counter() - began < 60
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "</li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<main>", "</main>", "<h1>", "x", " y "]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_blocks_go_with_any_element_around_them(page):
    own = parsed(page)
    for h in own.around():
        left = []
        for said, at in own.blocks:
            while at >= 0 and own.chain[at][0] != h:
                at = own.chain[at][1]
            left += [said] if at < 0 else []
        assert own.without({h}) == " ".join(left)


def test_templates_of_a_host_equal_a_count_by_hand(spark):
    rng = np.random.default_rng(5)
    parts = [f"<div class=k{i}><p>part {i}</p></div>" for i in range(12)]
    weights = np.linspace(0.02, 0.9, 12)
    rows = [(i, f"http://{'ab'[i % 3 == 0]}.org/{i}", "<body>" + "".join(p for p, w in zip(parts, weights) if rng.random() < w) + f"<article><p>words {rng.integers(40)}</p></article></body>") for i in range(60)]
    rows += [(1000 + i, u, h) for i, u, h in rows[:20]]
    seen = {}
    for _, url, html in rows:
        host, own = url[7:12], parsed(html)
        for s in {None, *own.subtrees}:
            seen.setdefault((host, False, s), set()).add(html)
        for s in {None, *own.around()}:
            seen.setdefault((host, True, s), set()).add(own.article)
    want = {(h, s) for (h, inside, s), pages in seen.items() if s is not None and len(pages) >= 5 and len(pages) >= min(0.2 * len(seen[h, inside, None]), 48)}
    got = templates(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(r.host, r.subtree) for r in got.collect()} == want and want


def test_templates_of_a_host_go(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div><p>Our site since 1999</p><p>Read more</p></div><p>Own text {i} here</p></body>", "x") for i in range(20)]
    rows += [(100 + i, "http://b.org/1", "<body><p>the very same page</p></body>", "x") for i in range(20)]
    rows += [(200, None, "<article>z</article>", "x"), (201, "http://a.org/q", None, "x"), (201, "http://a.org/q", None, "x"), (None, "u", "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    said = {}
    for r in got:
        said.setdefault(r.page_id, []).append(r.text)
    assert len(got) == len(rows)
    assert all(said[i] == [f"Own text {i} here"] for i in range(20))
    assert all(said[100 + i] == ["the very same page"] for i in range(20))
    assert said[200] == ["z"] and said[201] == ["", ""] and said[None] == [""]


def test_templates_inside_articles_go(spark):
    promo = "<div class=x7><p>Read our other stories</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body><div id=w><main>{promo}<article><p>Story number {i} is here</p></article></main></div></body>") for i in range(20)]
    # One article on many pages is no template of itself, nor is what three articles of twenty quote.
    rows += [(100 + i, f"http://b.org/{i}", f"<body><p>visit {i}</p><article><p>one and the same</p></article></body>") for i in range(20)]
    rows += [(200 + i, f"http://c.org/{i}", f"<article><p>own words {i}</p>{'<p>a quotation</p>' if i < 3 else ''}</article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most_sent in (1000, 0):
        said = {r.page_id: r.text for r in extract(df, most_sent=most_sent).collect()}
        assert all(said[i] == f"Story number {i} is here" for i in range(20))
        assert all(said[100 + i] == "one and the same" for i in range(20))
        assert all(said[200 + i] == f"own words {i}" + " a quotation" * (i < 3) for i in range(20))


def test_menus_of_a_section_of_a_large_host_go(spark):
    rows = [(i, f"http://a.org/{i}", f"<article>{'<p>Section menu</p>' if i < 50 else ''}{'<p>Rare</p>' if i >= 260 else ''}<p>words {i}</p></article>") for i in range(300)]
    said = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(said[i] == ("Rare " if i >= 260 else "") + f"words {i}" for i in range(300))


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
