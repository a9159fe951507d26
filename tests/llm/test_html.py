"""Extraction against a plain model on random trees, on hostile markup, and on odd tables."""

import random
import time

import pytest

from streamloom.llm import html_main

P = "<p>A long paragraph, with commas, and more than enough text to count as one, which goes on.</p>" * 3


@pytest.mark.parametrize("open_", ['div class="content no-sidebar"', 'div class="content-sidebar-wrap"', 'div class="post has-comments"', 'div class="entry-content share"', 'section class="article-body no-sidebar"', 'div id="content" class="has-sidebar"', 'article class="post has-comments"', 'div class="widget"'])
def test_class_words_of_a_wrapper_lose_no_article(open_):
    page = f"<html><body><nav>Menu</nav><{open_}>{P}</{open_.split()[0]}><footer>x</footer></body></html>"
    assert html_main.main_text(page).count("A long paragraph") == 3


def test_parts_of_an_article_below_several_wrappers():
    row = f"<div class=row><div class=col>{P}</div></div>"
    assert html_main.main_text(f"<body><div class=text>{row * 4}</div><div><p>Short</p></div></body>").count("A long paragraph") == 12


def test_text_around_what_is_left_out():
    assert html_main.main_text("<p>abc <noscript><div>x</div></noscript>def <select><option>a<option>b</select> ghi</p>") == "abc def ghi"
    assert html_main.main_text("<p>abc<button>x</p>def") == "abc\ndef"
    assert html_main.main_text(f"<a name=top>{P}").count("A long") == 3
    assert html_main.main_text('<p title="a > b">x</p><p title="a>y</p>') == "x\ny"


def test_short_blocks_and_marked_ones():
    assert html_main.main_text("<div>Hi there</div><p>ok</p>") == "Hi there\nok"
    assert html_main.main_text("<div class=menu>Hi there</div>") == ""


def test_equal_containers_go_by_page_order():
    one = lambda word: f"<div><p>{word}, a paragraph of some length, with commas in it.</p></div>"
    page = f"<body><section>{one('First')}</section><section>{one('Other')}</section></body>"
    assert html_main.main_text(page) == html_main.main_text(page) == "First, a paragraph of some length, with commas in it."


HOSTILE = {
    "no end of a tag": "<a " * 350_000,
    "deep": "<div>text, " * 100_000,
    "ends without starts": "<div>" * 100_000 + "x" + "</p>" * 100_000,
    "quoted ends": '<a x=">" ' * 110_000,
    "open quotes": "<a '>" * 200_001,
    "raw text": "<script>" + "</script " * 100_000,
    "comments": "<!--" * 250_000,
    "inline": "<b>" * 200_000 + "</i>" * 100_000,
    "outlived inline": "<b><div></b>" * 80_000,
    "paragraphs": "<p>x" * 250_000,
    "lists": "<ul><li>x" * 110_000,
    "marked": "<div class=ad>" * 50_000 + "<article>" * 50_000,
    "attributes": "<a " + "x=' " * 250_000 + ">",
    "spaces": "<a id" + " " * 1_000_000 + ">",
    "references": "&amp" * 250_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_takes_seconds(name):
    started = time.process_time()
    assert isinstance(html_main.main_text(HOSTILE[name]), str)
    assert time.process_time() - started < 30


# pages of stock markup

A = "<p>First, the article says one thing, with commas, and at some length too.</p><p>Then it goes on, with another, longer sentence, until it ends in this place.</p>"


@pytest.mark.parametrize(
    "inline,text",
    [
        ("<p>Call <span class='popup'>this word</span> a term, and go on with it for a while.</p>", "Call this word a term, and go on with it for a while."),
        ("<p>It is <em class=promo>really</em> so, and it stays so for a long time.</p>", "It is really so, and it stays so for a long time."),
        ("<p>See <a class='share' href=/x>that page</a>, which has more of it than this one.</p>", "See that page, which has more of it than this one."),
        ("<p>Press <label>Start</label> and wait until the light goes off again.</p>", "Press Start and wait until the light goes off again."),
        ("<pre><code><span class='token comment'># set x</span>\nx = <span class='token number'>1</span></code></pre>", "# set x x = 1"),
        ("<p><code><span class='comment'>// all of it</span></code></p>", "// all of it"),
        ("<p>A sentence of the article. <a class='share-button' href=/s>Share</a></p>", "A sentence of the article."),
        ("<p>By nobody <span class=social><a href=/a>Tweet</a> <a href=/b>Pin it</a></span> today</p>", "By nobody today"),
        ("<p><span class=ad>Buy it now, or never, as long as there is any.</span></p>", None),
        ("<div><a class=nav href=/a>Home</a> <a class=nav href=/b>About</a></div>", None),
        ("<div><label>Name</label><label>Street</label><input></div>", None),
        ("<span class=ad><div>Buy it now, or never, as long as there is any.</div></span>", None),
        ("<p>Here <span hidden>not seen</span> it is, in a sentence that has no other mark.</p>", "Here it is, in a sentence that has no other mark."),
    ],
)
def test_marks_of_inline_elements(inline, text):
    got = html_main.main_text(f"<body><article><h1>Title</h1>{A}{inline}<p>Last, as ever, comes the end of the article, which is this one.</p></article></body>").split("\n")
    assert got[3:-1] == ([] if text is None else [text]) and len(got) == 4 + (text is not None)


def remark(item, author="", date="", reply="", around="div"):
    text = "<p>Well, I think this is wrong, all of it, and I say so here at length.</p>"
    return f"<{around} class='{item}'>{author}{date}{text}{reply}</{around}>"


SIGNED = {
    "author": remark("item", "<span class=author>Jo</span>"),
    "says": remark("item", "<b>Jo says:</b>"),
    "date": remark("item", "", "<time>May 3</time>"),
    "date in words": remark("item", "", "<small>3 days ago</small>"),
    "reply": remark("item", "", "", "<a href=#r>Reply</a>"),
    "button": remark("item", "", "", "<button>Reply</button>"),
    "all": remark("row", "<cite class=fn>Jo</cite>", "<span>March 3, 2021 at 5:11 pm</span>", "<a href=#r>Reply</a>", "li"),
    "meta in a footer": "<article class=entry><footer><b class=author>Jo</b></footer><div><p>Well, I think this is wrong, all of it, and so on and on.</p></div></article>",
}


@pytest.mark.parametrize("count", [2, 12])
@pytest.mark.parametrize("around", ["<div class=list>{}</div>", "<div class=list><h3>Opinions (2)</h3>{}</div>", "<h3>Opinions (2)</h3>{}", "<section><h2>What you think</h2><div class=list>{}</div></section>"])
@pytest.mark.parametrize("sign", SIGNED)
def test_readers_words_by_structure(sign, around, count):
    page = f"<body><h1>Title</h1><div class=content>{A}</div>{around.format(SIGNED[sign] * count)}<footer>x</footer></body>"
    assert html_main.main_text(page).split("\n")[-1].startswith("Then it goes on") and "wrong" not in html_main.main_text(page) and "Opinions" not in html_main.main_text(page)


@pytest.mark.parametrize("sign", [k for k in SIGNED if not k.startswith("date")])
def test_readers_words_within_the_article(sign):
    got = html_main.main_text(f"<main><article><h1>Title</h1>{A}<div class=list>{SIGNED[sign] * 3}</div></article></main>")
    assert got.count("\n") == 2 and "wrong" not in got


@pytest.mark.parametrize("name", ["commentlist", "user-reviews", "discussion", "guestbook", "customer-feedback", "testimonials", "comment-list", "readerComments"])
def test_readers_words_by_name(name):
    assert "wrong" not in html_main.main_text(f"<body><div class=content>{A}</div><div class='{name}'>{remark('x')}{remark('x')}</div></body>")
    assert "wrong" not in html_main.main_text(f"<body><div class=content>{A}</div><ol class='{name}'>{remark('x', around='li')}{remark('x', around='li')}</ol></body>")


@pytest.mark.parametrize(
    "page,count",
    [
        (f"<body><h1>Paper</h1><section class=methods><h2>Methods</h2>{P}</section><section class=discussion><h2>Discussion</h2>{P}</section><section class=end><h2>End</h2>{P}</section></body>", 9),
        (f"<article><h1>Paper</h1><section class=methods><h2>Methods</h2>{P}</section><section class=discussion><h2>Discussion</h2>{P}</section></article>", 6),
        (f"<article><h1>Talk</h1>{P}<div class=part><time>1:10</time>{P}</div><div class=part><time>2:10</time>{P}</div></article>", 9),
        (f"<main><h1>Posts</h1><div class=post><h3><a href=/a>One</a></h3><span class=author>Jo</span>{P}</div><div class=post><h3><a href=/b>Two</a></h3><span class=author>Jo</span>{P}</div></main>", 6),
        (f"<article><h1>Quotes</h1>{P}<div class=q>{P}<span class=author>Jo</span></div><div class=q>{P}<span class=author>Al</span></div>{P}</article>", 12),
        ("<article><h1>Works</h1>" + P + "<ul>" + "<li><span class=author>Jo Doe</span>, A long paragraph, with commas, of a work</li>" * 3 + "</ul></article>", 6),
        (f"<main><article><h2>One</h2>{P * 4}</article><article><h2>Two</h2>{P}</article></main>", 15),
    ],
)
def test_articles_that_look_like_readers_words(page, count):
    assert html_main.main_text(page).count("A long paragraph") == count


def test_many_groups_and_signs_take_time_in_proportion():
    started = time.process_time()
    html_main.main_text(f"<body><h1>x</h1>{P}" + "<div><div class=a>" * 20_000 + (remark("c", "<b>Jo says:</b>") * 2 + "</div>") * 5_000 + "<span class=ad>x</span> y " * 50_000)
    html_main.main_text("<p>word <span class=ad>" * 100_000)
    assert time.process_time() - started < 30


# a plain model: trees of (tag, class, children), a child being a tree, a text or a link


def random_tree(rng, depth=0, out=False):
    """out: within a menu or an aside, which an article would end."""
    kind = rng.random()
    if depth and (kind < 0.45 or depth > 4):
        parts = [rng.choice([rng.randint(1, 60) * "word, ", rng.randint(1, 30) * "word ", ("a", rng.randint(1, 20) * "link ")]) for _ in range(rng.randint(1, 3))]
        return (rng.choice(["p", "p", "h2", "div"]), "", parts)
    tag, mark = rng.choice([("div", ""), ("section", ""), ("div", "x"), ("nav", ""), ("aside", ""), ("div", "sidebar"), ("div", "comments"), ("article", ""), ("div", "share")]) if depth else ("body", "")
    tag, out = "div" if out and tag == "article" else tag, out or tag in ("nav", "aside")
    return (tag, mark, [random_tree(rng, depth + 1, out) for _ in range(rng.randint(1, 4))])


def written(tree):
    if isinstance(tree, str):
        return tree
    if tree[0] == "a":
        return f"<a href=/>{tree[1]}</a>"
    return f"<{tree[0]} class='{tree[1]}'>" + "".join(map(written, tree[2])) + f"</{tree[0]}>"


def plain_text(tree):
    blocks = []  # (path from the root, text, characters in links)

    def walk(node, path):
        path = [*path, node]
        inline = [c for c in node[2] if isinstance(c, str) or c[0] == "a"]
        if inline:
            text = " ".join("".join(c if isinstance(c, str) else c[1] for c in inline).split())
            blocks.append((path, text, min(len(text), sum(len(c[1].strip()) for c in inline if not isinstance(c, str)))))
        for c in node[2]:
            if not isinstance(c, str) and c[0] != "a":
                walk(c, path)

    walk(("", "", [tree]), [])
    every = [b for b in blocks if not any(n[0] in ("nav", "aside") for n in b[0])]
    marked = lambda n: n[1] in ("sidebar", "comments", "share")

    def points(b):
        return 0.0 if len(b[1]) < 25 or b[0][-1][0] == "h2" else (1 + b[1].count(",") + min(len(b[1]) // 100, 3)) * (1 - b[2] / len(b[1]))

    def below(n, rows):
        return [b for b in rows if any(x is n for x in b[0])]

    def held(rows):
        return sum(map(points, rows))

    def titled(rows):
        return [b for b in rows if any(x[0] == "article" and not marked(x) for x in b[0])]

    def around(n):
        own, total = held(below(n, every)), held(every)
        if 2 * own <= total or n[1] == "comments":
            return False
        alone = total - own < 0.1 * total
        if not titled(every):
            return alone and sum(points(b) > 0 for b in below(n, every)) > 1
        return len(titled(below(n, every))) == len(titled(every)) or alone and bool(titled(below(n, every)))

    rows = [b for b in every if all(not marked(n) or around(n) for n in b[0])]
    if not rows:
        rows = every
        if not held(rows):
            return ""

    def score(n):
        own = sum(points(b) for b in rows if (b[0][-2] if b[0][-1][0] == "p" else b[0][-1]) is n)
        return own + sum(score(c) for c in n[2] if not isinstance(c, str) and c[0] != "a") / 2

    def density(n):
        own = below(n, rows)
        return sum(b[2] for b in own) / max(sum(len(b[1]) for b in own), 1)

    def worth(n):
        return score(n) * (1 - density(n))

    nodes, parent = [], {}

    def order(n, up):
        nodes.append(n)
        parent[id(n)] = up
        for c in n[2]:
            if not isinstance(c, str) and c[0] != "a":
                order(c, n)

    order(tree, None)
    if held(rows):
        best = max([n for n in nodes if score(n) > 0], key=worth)
        while 2 * held(below(best, rows)) < held(rows) and parent[id(best)] is not None and parent[id(best)][0] != "body":
            best = parent[id(best)]
        up = best
        while up is not None and up[0] != "article":
            up = parent[id(up)]
        best = up or best
        keep = [best]
        for n in nodes:
            if best[0] != "body" and n is not best and parent[id(n)] is parent[id(best)]:
                size = sum(len(b[1]) for b in below(n, rows))
                least = 0.2 * worth(best) if n[0] == best[0] == "article" else max(10.0, 0.2 * worth(best))
                if worth(n) >= least or density(n) < 0.25 and (n[0] == "p" and size > 80 or n[0] == "h2"):
                    keep.append(n)
    else:
        keep = [n for n in nodes if n[0] == "article" and below(n, rows)][:1] or [tree]
    return "\n".join(b[1] for b in rows if any(x is k for x in b[0] for k in keep))


def test_random_trees_match_a_plain_model():
    rng = random.Random(8)
    lengths = []
    for _ in range(600):
        tree = random_tree(rng)
        got = html_main.main_text(written(tree))
        assert got == plain_text(tree), written(tree)
        lengths.append(len(got))
    assert sum(n > 0 for n in lengths) > 400


def test_empty_tables_and_clashing_names(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, kept string"
    assert html_main.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", P, "a", "b", "c"), (1, "u", P, "a", "b", "c"), (None, None, None, None, None, None)]
    got = html_main.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text.count("A long"), r.n_chars == len(r.text)) for r in got) == [("1", 3, True), ("1", 3, True), ("None", 0, True)]
