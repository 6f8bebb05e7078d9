"""Tree matching against its definition, and extraction from several page layouts."""
import random
from functools import lru_cache

import pytest

from marketframe.llm import wrappers as w


def brute(a, b):
    """Size of the largest order-preserving match of two nested trees (label, children) with equal roots."""
    @lru_cache(None)
    def pair(x, y):
        if x[0] != y[0]:
            return 0
        best = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, u in enumerate(x[1], 1):
            for j, v in enumerate(y[1], 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pair(u, v))
        return best[-1][-1] + 1
    return pair(a, b)


def tree(rng, depth=0):
    return (rng.choice("ab") if depth else "r", tuple(tree(rng, depth + 1) for _ in range(rng.randint(0, 3) if depth < 3 else 0)))


def preorder(t, depth=0):
    return [(depth, t[0])] + [x for c in t[1] for x in preorder(c, depth + 1)]


@pytest.mark.parametrize("seed", range(40))
def test_simple_tree_matching(seed):
    rng = random.Random(seed)
    a, b = tree(rng), tree(rng)
    pa, pb = preorder(a), preorder(b)
    got = w.match(pa, pb)
    assert len(got) == brute(a, b) and len(set(got.values())) == len(got)
    assert all(pa[i] == pb[j] for i, j in got.items())
    order = [got[i] for i in sorted(got)]
    assert order == sorted(order)


def words(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def pages(layout, n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        head, paras = words(rng, 5).capitalize(), [words(rng, rng.randint(15, 60)) for _ in range(rng.randint(1, 6))]
        links = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in words(rng, 6).split())
        out.append((layout(rng, head, paras, links), "\n".join([head, *paras])))
    return out


LAYOUTS = {
    "semantic": lambda g, h, p, li: f"<html><head><title>{h}</title><script>var a='<p>no</p>'</script></head><body><header><a href=/>Site</a> Tagline</header><nav><ul>{li}</ul></nav>"
                f"<main><article><h1>{h}</h1>{''.join(f'<p>{x}' for x in p)}<section class=comments><p>{words(g, 30)}</p></section></article></main>"
                f"<aside>{words(g, 20)}</aside><form>Mail <input></form><footer>&copy; Site</footer></body></html>",
    "classes": lambda g, h, p, li: f"<body><div id=top-bar><p>{words(g, 12)}</p></div><div class='main-menu'><ul>{li}</ul></div><div class=cookie-notice>We use cookies</div>"
                f"<div class='post-content'><h2>{h}</h2>{''.join(f'<p>{x}</p>' for x in p)}</div><div class='sidebar right'><p>{words(g, 25)}</p></div>"
                f"<div id=comments><h3>Comments</h3><p>{words(g, 40)}</p></div><div class=footer>All rights</div></body>",
    "anonymous": lambda g, h, p, li: f"<div class=c1>Welcome to our fine site, dear reader, enjoy all of it</div><div class=c2>{li}</div><div class=c3><h1>{h}</h1>"
                f"{''.join(f'<div class=k>{x}</div>' for x in p)}</div><div class=c4>Read our terms and the rest of the small print here</div>",
    "table": lambda g, h, p, li: f"<table class=outer><tr><td><ul>{li}</ul><td><div class=story><h1>{h}</h1>{'<br>'.join(p)}</div></table><div class=ad>{words(g, 9)}</div>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(spark, name):
    rows = pages(LAYOUTS[name], 25)
    df = spark.createDataFrame([(i, f"https://{name}.example/{i}", h, "host") for i, (h, _) in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in w.extract(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(rows)}


def test_recurring_text_inside_the_article_stays(spark):
    page = lambda i: f"<nav>menu</nav><article><h1>The same title</h1><p>Same intro for all.</p><p>{words(random.Random(i), 30)}</p></article>"
    df = spark.createDataFrame([(i, "http://h/", page(i)) for i in range(9)] + [(100 + i, "http://h/", page(1)) for i in range(30)], "page_id long, url string, html string")
    assert all(r.text.startswith("The same title\nSame intro for all.\n") for r in w.extract(df).collect())


def test_blocks_and_references():
    text = w.text_of("<article><h1>A &amp; B</h1>\n<p>one\n  two&nbsp;<b>thr</b>ee &#233;&lt;<!-- no --> <p>x<br>y<ul><li>a<li>b</ul>tail</article>", None)
    assert text == "A & B\none two three é<\nx\ny\na\nb\ntail"


def test_odd_pages(spark):
    deep = "<div>" * 300 + "core text" + "</div>" * 300
    rows = [(1, None, None), (2, "", ""), (None, "notaurl", "plain"), (3, "http://h/x", "<p>unclosed <b>bold"), (3, "http://h/x", "<p>unclosed <b>bold"),
            (4, "http://h/y", "</div></p>lone"), (5, "http://h/z", "<" * 2000), (6, "http://h/z", deep), (7, "http://h/q", "<article></article>"),
            (8, "http://h/l", "<article><p>" + "w " * 400_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.n_chars, r.text[:9]) for r in w.extract(df).collect())
    assert len(got) == len(rows)
    assert ("1", 0, "") in got and ("None", 5, "plain") in got and got.count(("3", 13, "unclosed ")) == 2 and ("6", 9, "core text") in got and ("7", 0, "") in got
    assert ("8", 799_999, "w w w w w") in got and ("4", 4, "lone") in got
    assert w.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<article>" + "<div>" * 100_000 + "deep" + "</div>" * 100_000 + "<p>after</article>", "deep\nafter"),
    ("<article>" + "<b>" * 100_000 + "deep" + "</b>" * 100_000 + " after</article>", "deep after"),
    ("<article><p>one" + "<div>" * 300 + "<p>two<div class=nav>menu</div>three" + "</div>" * 300 + "four</article>", "one\ntwo\nthree\nfour"),
    ("<article><p>" + "</i>" * 100_000 + "x" + "<li>" * 50_000 + "y</article>", "x\ny"),
])
def test_deep_markup(html, text):
    import time
    start = time.time()
    assert w.text_of(html, None) == text
    assert time.time() - start < 10


@pytest.mark.parametrize("html", ["<p>" + "<b x" * 300_000, "<p>x" + "<" * 500_000, "<p>y<a title=\"" + "<b c='" * 200_000, "<p>" + "<a b=\"'>'" * 200_000, "<!--" * 300_000, "<p>" + "<p a='" * 100_000 + ">" * 10,
                                  "<table>" + "<td><b>" * 60_000, "<p>" + "<![CDATA[" * 200_000])
def test_unclosed_markup_is_read_once(html):
    import time
    start = time.time()
    w.text_of(html, None)
    assert time.time() - start < 10


def test_quotes_and_brackets_in_tags():
    assert w.text_of("<article><p title=\"a > b\" class='x>y'>one <a href=u'>two</a> 3 < 4 <5> a<b c</article>", None) == "one two 3 < 4 <5> a"
    assert w.text_of("<p>a <!-- > <p> --> b <![CDATA[c]]> d <!doctype x> e", None) == "a b d e"


def test_a_varying_list_of_links_in_the_article_stays(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(8):
        body, names = words(rng, 40), words(rng, 5).split()
        refs = "".join(f"<li><a href='/{n}'>{n}</a></li>" for n in names)
        rows.append((i, f"http://refs/{i}", f"<nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>{body}</p><ul>{refs}</ul></article><footer>end</footer>"))
        want[i] = "\n".join([f"Title {i}", body, *names])
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_only_the_constant_one_of_equal_siblings_goes(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(8):
        first, listed = words(rng, 30), words(rng, 4)
        rows.append((i, f"http://equal/{i}", f"<body><article><h1>Title {i}</h1><div><p>{first}</p></div><ul><li>{listed}</li></ul><div>Print this page or save it</div></article></body>"))
        want[i] = f"Title {i}\n{first}\n{listed}"
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
