import random
import re
import time

import pytest

from tallyforge.llm import sitetemplates as S

PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p><b>One\n two<br><p>Three&#233; <i>x</i>y</p><script>var t='</p>';</script></article><footer>&copy;</footer></body></html>": "Head & more\nOne two\nThreeé xy",
    "<article><p>a<p>b<div id=comments><p>reader</p></div><ul><li>c<li>d</ul><aside>note</aside><form><p>f</p></form></article>": "a\nb\nc\nd",
    "<article><header>top</header><p>cut off mid": "cut off mid",
    "<body><p>no article</p><header>h</header><div role=navigation>n</div><p hidden>x</p>tail": "no article\ntail",
    "<article><p>a &lt;b&gt; &amp;amp; &nbsp;c</p><!-- no --><p> </p><pre>x\ty</pre></article><p>outside</p>": "a <b> &amp; \xa0c\nx y",
    "1 < 2 <p>three": "1 < 2\nthree",
    "<script>only</script>": "",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert S.main_text(S.parse(page), frozenset()) == PAGES[page]


KEPT = {
    '<div class="site has-sidebar"><article><p>keep</p></article></div>': "keep",
    '<article class="post share-enabled category-ads tag-cookies"><p>keep</p><div class="share-buttons">Share</div></article>': "keep",
    '<div class="content no-sidebar comments-open"><p>keep this and that</p></div><div class="cookie-banner">We use</div>': "keep this and that",
    "<a x='" * 3 + "><p>after a quote that nothing closes": "after a quote that nothing closes",
}


@pytest.mark.parametrize("page", KEPT)
def test_marks_are_whole_names_and_never_around_the_main_text(page):
    assert S.main_text(S.parse(page), frozenset()) == KEPT[page]


@pytest.mark.parametrize("page", ["<a " * 20_000, "<a x='" * 20_001 + ">", "<b>" * 8000 + "</p></i>" * 8000 + "<p>x", "<div>" * 5000 + "x" + "</p>" * 100_000, "<" * 200_000, "<!--" * 50_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    S.main_text(S.parse(page), frozenset())
    assert time.process_time() - began < 2


def test_site_templates_go_and_repeated_articles_stay(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"http://a.example/{k}", f"<body><div><span>Our site</span></div><div><p>story {k}</p></div><div class=x>more {k}</div></body>", "t"))
        rows.append((100 + k, f"http://b.example/{k}", f"<body><div>Site line</div><article><p>the same story</p><p>told {k}</p><section>boiler</section></article></body>", "t"))
        rows.append((200 + k, f"http://c{k}.example/", "<body><div>Site line</div><p>x</p></body>", "t"))
        rows.append((400 + k, f"http://e.example/{k}", "<body><div><p>one text that this host has twelve times</p></div><div>and no other</div></body>", "t"))
    rows += [(300, None, None, "t"), (301, "", "<nav>only</nav>", "t"), (0, rows[0][1], rows[0][2], "t"), (302, "http://d.example/", "<article>" + "<p>long text</p>" * 5000 + "</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string").repartition(4)
    out = S.extract(df).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[5] == "story 5\nmore 5" and got[100] == "the same story\ntold 0" and got[203] == "Site line\nx"
    assert got[400] == "one text that this host has twelve times\nand no other"
    assert got[300] == got[301] == "" and got[302].count("\n") == 4999


def rendered(node):
    if isinstance(node, str):
        return node
    tag, attributes, children = node
    return f"<{tag}{''.join(f' {k}="{v}"' for k, v in attributes.items())}>{''.join(map(rendered, children))}</{tag}>"


def site(rng, host, k, varied):
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    links = [("li", {}, [("a", {"href": f"/{word()}"}, [word()])]) for _ in range(rng.randrange(3, 7))]
    body = [("div", {"class": f"top-{k}" if varied else "top"}, [("ul", {}, links)]), ("div", {"class": "line"}, [f"{host} for you"])]
    body += [("article", {}, [("h1", {}, [word()]), *[("p", {}, [" ".join(word() for _ in range(30))]) for _ in range(rng.randrange(1, 4))], ("div", {}, ["share this"]), ("div", {}, [word()])])]
    body += [("div", {"class": "end"}, [word(), ("b", {}, [word()])])] * rng.randrange(1, 3)
    return ("body", {}, body)


def subtrees_of(node, inside=False, place=(), around=True):
    """(where, exact, shape, node) of all elements; where: 0 outside, 1 around, 2 article, 3 inside."""
    tag, attributes, children = node
    where = 3 if inside else 2 if tag == "article" else 1 if tag == "body" else 0
    name = re.sub("[0-9]+", "#", attributes.get("class", ""))

    def shape(n):
        if isinstance(n, str):
            return "#"
        parts = [shape(c) for c in n[2]]
        return (n[0], re.sub("[0-9]+", "#", n[1].get("class", "")), tuple(sorted(n[1])), tuple(x for i, x in enumerate(parts) if not i or x != parts[i - 1]))

    yield where, repr(node), (place, shape(node)), node
    for c in children:
        if not isinstance(c, str):
            yield from subtrees_of(c, where >= 2, (*place, tag, name))


def size_of(node):
    return len(node) if isinstance(node, str) else sum(size_of(c) for c in node[2] if isinstance(c, str) or c[0] != "a")


def brute(pages):
    """pages: (host, tree) to texts without lists, by counting strings."""
    def candidates(page):
        out = {}
        for where, exact, shape, node in subtrees_of(page):
            if where in (1, 2) or not node[2]:
                continue
            if where == 0 or node[0] == "div":
                out[("inner" if where == 3 else "tree", exact)] = None
            if where == 0:
                out[("shape", shape)] = out.get(("shape", shape), 0) + size_of(node)
        return out

    seen, host_pages, text = {}, {}, {}
    for host, page in pages:
        article = repr(next(n for w, *_, n in subtrees_of(page) if w == 2))
        host_pages.setdefault(host, set()).add(article)
        for key, size in candidates(page).items():
            seen.setdefault((host, *key), set()).add(article)
            if key[0] == "shape":
                a, b = text.get((host, *key), (0, 0))
                text[(host, *key)] = (a + size, b + size_of(page))
    template = set()
    for key, articles in seen.items():
        least, share = (S.INNER_PAGES, S.INNER_SHARE) if key[1] == "inner" else (S.MIN_PAGES, S.MIN_SHARE)
        n = len(articles)
        if n >= least and n >= share * len(host_pages[key[0]]) and (key[1] != "shape" or text[key][0] <= S.MAX_TEXT_SHARE * text[key][1]):
            template.add(key)

    def blocks(host, node, inside, place, out):
        tag, attributes, children = node
        for where, exact, shape, same in subtrees_of(node, inside, place):
            break
        if where in (0, 3) and ((host, "tree", exact) in template or (host, "inner", exact) in template or (where == 0 and (host, "shape", shape) in template)):
            return
        out.append("\0") if tag not in ("a", "b") else None
        for c in children:
            out.append(c) if isinstance(c, str) else blocks(host, c, where >= 2, (*place, tag, re.sub("[0-9]+", "#", attributes.get("class", ""))), out)
        out.append("\0") if tag not in ("a", "b") else None

    texts = []
    for host, page in pages:
        out = []
        blocks(host, page, False, (), out)
        texts.append("\n".join(x for x in "".join(out).split("\0") if x))
    return texts


def test_templates_match_brute_force(spark):
    rng = random.Random(4)
    pages = []
    for host, n in (("one.example", 30), ("two.example", 8), ("few.example", 3)):
        pages += [(host, site(rng, host, k, n == 8)) for k in range(n)]
    pages += pages[:6]
    df = spark.createDataFrame([(k, f"http://{host}/{k}", rendered(page)) for k, (host, page) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in S.extract(df.repartition(3), parts=True).collect()}
    expected = brute(pages)
    for k, text in enumerate(expected):
        assert got[k]["without_lists"] == text
    # menus, adverts and footers went by repetition alone where there are pages enough, and only there
    assert all("\n".join(got[k]["text"].split("\n")) == got[k]["without_lists"] for k in range(38)) and got[39]["text"] != got[39]["without_lists"]


def test_templates_joined_by_host_are_the_same(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([(k, "http://one.example/", rendered(site(rng, "one", k, False))) for k in range(12)], "page_id long, url string, html string")
    usual = sorted(map(tuple, S.extract(df).collect()))
    monkeypatch.setattr(S, "BROADCAST_TEMPLATES", 0)
    assert sorted(map(tuple, S.extract(df).collect())) == usual


def test_empty(spark):
    assert S.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
