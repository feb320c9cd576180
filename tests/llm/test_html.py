import random

import numpy as np
import pytest

from lumenquad.llm.html_extraction import Stream, blocks_of, extract


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>comment</p> --><div class="cookie-notice">We use</div>
    <article><header><h1>Tit&auml;l &amp; more</h1></header><p>One <b>bold</b>word<br>next&nbsp;line<p>Two <a title="a > b">x</a></p><aside>side</aside>
    <form><p>Mail</p></form><section id="comments"><p>first!</p></section><ul><li>l1<li>l2</ul><p class='ad'>buy</p>tail</article><footer>&copy; us</footer></body>"""
    assert blocks_of(page) == ["Titäl & more", "One boldword next line", "Two x", "l1", "l2", "tail"]
    assert blocks_of("<div class='site-header'>x</div><article><div class='post-header'><h1>T</h1></div><p>a</p></article>") == ["T", "a"]
    assert blocks_of("<p>a<p>b</div></p>c<script>x") == ["a", "b", "c"]
    assert blocks_of("plain & text <") == ["plain & text <"] and blocks_of("<div class=sidebar>x</div>") == []


def rows(spark):
    menu = "Start page and all of our many nice topics of today"
    out = [(i, f"http://h.example/{i}", f"<p>{menu}</p><p>own text {i} about thing {i * 7} and more of {i * 13}</p>") for i in range(20)]
    out += [(100 + i, f"http://few.example/{i}", f"<p>{menu}</p><p>text {i}</p>") for i in range(3)]
    out += [(200, None, None), (201, "x", ""), (202, "http://h.example/copy", out[3][2]), (203, "http://u:p@H.example/x", "<article></article>")]
    return spark.createDataFrame([(*r, "c") for r in out], "page_id long, url string, html string, part string"), menu


def test_boilerplate_of_a_host_goes_and_copies_stay(spark):
    df, menu = rows(spark)
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == df.count()
    for i in range(20):
        assert got[i].text == f"own text {i} about thing {i * 7} and more of {i * 13}" and got[i].n_chars == len(got[i].text)
    assert got[202].text == got[3].text and got[101].text == f"{menu}\n\ntext 1" and (got[200].text, got[201].n_chars, got[203].text) == ("", 0, "")
    assert {r.page_id: r.text for r in extract(df, group=8, few=3).collect()}[5] == got[5].text
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>Hello <button>Share</button> brave <span class='ad'>x</span> world</p>", ["Hello brave world"]),
        ("<div class='layout has-sidebar'><nav>n</nav><article><p>a</p></article></div>", ["a"]),
        ("<div class='sidebar'><article><p>a</p></article></div>", ["a"]),
        ("<form id=aspnet><h1>T</h1><p>x</p></form>", ["T", "x"]),
        ("<form><article><p>x</p></article></form><form>mail</form>", ["x"]),
        ("<article><p id=share-prices>s</p><div class='related-work'>r</div></article>", ["s", "r"]),
        ("<p>Intro</p><article>teaser</article><p>rest</p>", ["Intro", "teaser", "rest"]),
        ("<article>a</article><aside><article>card</article></aside><div id=comments><article>first!</article></div>", ["a"]),
        ("<div role=navigation>n</div><div class='site-footer'>f</div><div class='comment-list'>c</div><div class=adSlot2>b</div>", []),
    ],
)
def test_markup_by_what_it_states(page, want):
    assert blocks_of(page) == want


def brute(pages, least, share, few):
    """Tokens in strings of `least` tokens on enough pages, two of which have a quarter of their own text."""
    flat = [[t for b in p for t in b.split(" ")] for p in pages]
    on = {}
    for i, p in enumerate(flat):
        for a in range(len(p) - least + 1):
            on.setdefault(tuple(p[a : a + least]), set()).add(i)

    def cover(strings):
        out = []
        for p in flat:
            gone = np.zeros(len(p), bool)
            for a in range(len(p) - least + 1):
                if tuple(p[a : a + least]) in strings:
                    gone[a : a + least] = True
            out.append(gone)
        return out

    often = {s for s, x in on.items() if len(x) >= max(few, share * len(pages))}
    own = [4 * g.sum() <= 3 * len(g) for g in cover(often)]
    return cover({s for s in often if sum(own[i] for i in on[s]) >= 2})


def test_boilerplate_equals_brute_force():
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    changed = 0
    for _ in range(60):
        menus = [prose(r.randrange(3, 14)) for _ in range(3)]
        pages = []
        for _ in range(r.randrange(1, 12)):
            page = [r.choice([*menus, prose(r.randrange(1, 25))]) for _ in range(r.randrange(0, 6))]
            pages += [page] * r.choice([1, 1, 1, 3])
        want = brute(pages, 4, 0.5, 3)
        stream = Stream(pages, 4)
        got = stream.gone(np.unique(stream.common(0.5, 3)))
        assert all((x == y).all() for x, y in zip(got, want, strict=True))
        changed += sum(x.any() for x in want)
    assert changed > 50


def test_host_of_many_groups_is_judged_as_one(spark):
    """Undeclared boilerplate goes from every page of a large host, and an article copied there stays whole."""
    menu = "Start page and all of our many nice topics of today"
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(i, "http://big.example/", f"<div><div>{menu}</div><p>{own(i)}</p></div>") for i in range(200)]
    rows += [(1000 + i, "http://big.example/", f"<p>{own(7)}</p>") for i in range(3)] + [(2000, "http://big.example/", f"<p>{'long ' * 200_000}{menu}</p>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), group=16).collect()}
    assert all(got[i] == own(i) for i in range(200)) and all(got[1000 + i] == own(7) for i in range(3))
    assert sum(menu in t for t in got.values()) == 0 and len(got) == 204


def test_copies_on_a_small_host_stay(spark):
    article = " ".join(f"word{k}" for k in range(40))
    rows = [(i, "http://small.example/", f"<p>{article}</p>") for i in range(4)] + [(9, "http://small.example/", "<p>another page</p>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == article for i in range(4))


@pytest.mark.parametrize("percent,stays", [(55, True), (58, True), (60, False), (65, False)])
def test_equal_for_every_group_size(spark, percent, stays):
    """A sentence on a share of a host's pages goes from all of them or from none, however the pages are dealt."""
    line = "Read more about our seven other offers of the week"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    r = random.Random(percent)
    n = 40
    on = set(r.sample(range(n), n * percent // 100))
    assert len(on) * 100 >= 60 * n or stays
    rows = [(i, "http://h.example/", f"<div><p>{own(i)}</p>{f'<p>{line}</p>' if i in on else ''}</div>") for i in range(n)]
    # A small host beside it, and pages that copy one article.
    rows += [(100 + i, "http://s.example/", f"<p>{own(100 + i)}</p><p>{line}</p>") for i in range(4)] + [(200 + i, "http://c.example/", f"<p>{own(7)}</p>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = [{x.page_id: x.text for x in extract(df, group=g).collect()} for g in (512, 8, 5)]
    assert all(f == found[0] for f in found[1:])
    for i in range(n):
        assert found[0][i] == (f"{own(i)}\n\n{line}" if i in on and stays else own(i))
    assert all(found[0][100 + i] == own(100 + i) for i in range(4)) and all(found[0][200 + i] == own(7) for i in range(30))


def test_known_articles_amid_unmarked_boilerplate(spark):
    """Plain divs all through: what repeats on the host goes, the articles come back whole."""
    r = random.Random(9)
    word = lambda: r.choice("time year people way day man thing woman life child world school state family student".split()) + str(r.randrange(60))
    prose = lambda n: " ".join(word() for _ in range(n))
    top, bottom, middle = (f"{k} {prose(12)}" for k in ("top", "bottom", "middle"))
    articles = [[prose(r.randrange(20, 60)) for _ in range(r.randrange(2, 6))] for _ in range(60)]
    page = lambda a: f"<div>{top}</div>" + "".join(f"<div>{p}</div>" for p in a[:2]) + f"<div>{middle}</div>" + "".join(f"<div>{p}</div>" for p in a[2:]) + f"<div>{bottom}</div>"
    df = spark.createDataFrame([(i, "https://news.example/a", page(a)) for i, a in enumerate(articles)], "page_id long, url string, html string")
    for group in (512, 16):
        got = {x.page_id: x.text for x in extract(df, group=group).collect()}
        assert all(got[i] == "\n\n".join(a) for i, a in enumerate(articles))
