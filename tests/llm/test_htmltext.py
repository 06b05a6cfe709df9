import html as h
import re

import pytest

from tidemark.llm import htmltext

P1 = "This is the first paragraph, with commas, and enough text to count as one."
P2 = "A second one, also long, which says a few more things about the matter."
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-consent"><p>We use cookies, and more cookies, on this page to improve it.</p></div><header class="site"><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News, sports, and weather for all of you</a></ul></nav>@@<footer>&copy; 2024, all rights reserved, by everyone involved here.</footer></body></html>"""
BODIES = [
    (f"<article><h1>Title</h1><p>{P1}<p>{P2} &amp; more&nbsp;so</article>", f"Title\n{P1}\n{P2} & more so"),
    (f'<div class="content"><h2>T</h2><p>{P1}</p><p>Short.</p><p>{P2}</p></div><div class="sidebar"><p>{P2}</p></div>', f"T\n{P1}\nShort.\n{P2}"),
    (f'<main><p>{P1}</p><form><p>{P2}</p></form><div class="ad-slot">Buy, buy, and buy again, all of this today</div><section><p>{P2}</p></section></main><section id="comments"><p>I disagree, strongly, with all of it, and so do you.</p></section>', f"{P1}\n{P2}"),
    (f"<div><div><p>{P1}</p></div><div><p>{P2}</p></div></div>", f"{P1}\n{P2}"),
    (f"<article><header><h1>Own</h1></header><p>{P1}</p><aside><p>{P2}</p></aside><table><tr><td>x<td>y</table></article>", f"Own\n{P1}\nx\ny"),
    (f'<article><div class="notice">Read this, and that, before anything else here.</div><p class="ad">Buy now, and here<p>{P1}</p><div><p class="promo">x, y, z</div><p>{P2}</p><footer>f</footer></article>', f"{P1}\n{P2}"),
    (f'<div id="wrap"><h1>Head</h1><div class="entry-content"><p>{P1}</p><p>{P2}</p></div><ul class="share-links"><li>Share</ul><div class="related">More, more, and more of the same for you.</div></div>', f"Head\n{P1}\n{P2}"),
    (f"<article><p>{P1}</p><!-- <p>no</p> --><p><b>bold</b> <i>it</i>alic <a href='x>y'>link</a></p></article>", f"{P1}\nbold italic link"),
]


@pytest.mark.parametrize("body,want", BODIES)
def test_pages(body, want):
    assert htmltext.main_text(PAGE.replace("@@", body)) == want


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain", "plain"), ("<p>", ""), ("<<<>", "<<<>"), ("a < b", "a < b"), ("<!-- open", ""), ("<script>x", ""), ("<p>one<p>two", "one\ntwo"), ("</p></div>x", "x"), ("<nav>menu", ""),
    ("<body hidden>x</body>", "x"), ("&#x41;&eacute;&unknown;", "Aé&unknown;"), ("<P CLASS=x>Up</P>", "Up"),
])
def test_odd_markup(page, want):
    assert htmltext.main_text(page) == want


def test_bounded_work():
    for page in ("<a " * 20_000, "<div>" * 20_000 + "x", '<a "' * 20_000, "<p>" * 20_000, "</b>" * 20_000, "<b>" * 5_000 + "</i>" * 5_000):
        assert len(htmltext.main_text(page)) <= 1


def test_rows(spark):
    rows = [(1, "u", PAGE.replace("@@", BODIES[0][0]), 3, "x"), (2, None, None, 3, "x"), (None, "u", "", 3, "x"), (1, "u", "<p>é</p>", 3, "x"), (5, "u", "<p>" + "word, " * 100_000, 3, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in htmltext.main_texts(df).collect()}
    assert got[1, len(BODIES[0][1])] == BODIES[0][1] and got[2, 0] == "" and got[None, 0] == "" and got[1, 1] == "é" and (5, 599_999) in got
    assert htmltext.main_texts(df.limit(0)).count() == 0


def test_whole_table_equals_articles(spark):
    """The test pages hold their text in <article>: a pattern gives the same blocks."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in htmltext.op9_tree_scoring(spark, "/root/testdata/sf0.001").collect()}
    for p in pages:
        a = re.search(r"<article>(.*?)</article>", p["html"], re.S).group(1)
        a = re.sub(r"<br>", " ", re.sub(r"</?(h1|p)>", "\n", a))
        lines = (" ".join(x.split()) for x in h.unescape(re.sub(r"<[^>]*>", "", a)).split("\n"))
        assert got[p["page_id"]] == "\n".join(x for x in lines if x)


STORY = "The harbour town rebuilt its old lighthouse last year, stone by stone, and the keepers came back to see the work."


def test_attributes_are_read_by_name():
    for attrs in ('data-hidden="false"', 'title="The hidden story"', 'data-id="comment-5"', 'data-class="sidebar"', 'class="post overflow-hidden"', 'class="content with-sidebar"', 'class="post category-social"'):
        assert htmltext.main_text(f"<body><div {attrs}><p>{STORY}</p><p>{STORY}</p></div></body>") == f"{STORY}\n{STORY}", attrs
    linked = f'<body><div><p>{STORY} See <a href="/hidden-fees">the fees</a> and <a href="/p?id=menu">the list</a>.</p><p>{STORY}</p></div></body>'
    assert "See the fees and the list." in htmltext.main_text(linked)


def test_article_stays_whatever_its_class():
    for tag in ('article class="post social"', 'main class="content sidebar"', 'div itemprop="articleBody" class="widget"'):
        assert htmltext.main_text(f"<body><{tag}><p>{STORY}</p></{tag.split()[0]}></body>") == STORY, tag
    assert htmltext.main_text(f'<body><article hidden><p>{STORY} Not shown.</p></article><article><p>{STORY}</p></article></body>') == STORY
    assert htmltext.main_text(f'<body><div class="site-footer"><p>{STORY} Below.</p></div><div><p>{STORY}</p></div></body>') == STORY


def test_tags_of_any_length_and_quoting():
    for tag in (f'<img src="data:{"x" * 70_000}" alt="a > b">', '<img title = "x > y">', "<img data-x='it\"s > this'>", "<img a=b/c d>", '<img alt="a" alt=">">', "<img\n\talt\n=\n'>'\n/>"):
        assert htmltext.main_text(f"<article><p>{P1}{tag} {P2}</p></article>") == f"{P1} {P2}", tag[:40]
    # a quote that never ends is a plain character
    assert htmltext.main_text(f'<article><p title="open>{P1}</p></article>') == P1
    assert htmltext.main_text(f"<article><p title='open>{P1}</p></article>") == P1


def test_formulas_and_drawings_in_the_line():
    text = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be, in <svg><title>no</title><g><text>Fig 1</text></g></svg> too.</p>"
    assert htmltext.main_text(f"<article>{text}<p>{P1}</p></article>") == f"Let x=2 be, in Fig 1 too.\n{P1}"


def test_names_alone_leave_nothing_out():
    inside = '<h2 class="social-history">Clubs</h2><p class="share-price">It rose.</p><ul class="menu-items"><li>Soup<li>Bread</ul><p id="related-work">Others.</p>'
    assert htmltext.main_text(f"<article><p>{P1}</p>{inside}</article>") == f"{P1}\nClubs\nIt rose.\nSoup\nBread\nOthers."
    links = '<ul class="share-this"><li><a href="/a">One place</a><li><a href="/b">Another</a></ul>'
    assert htmltext.main_text(f"<article><p>{P1}</p>{links}</article>") == P1
    # a wrapper that holds the page, whatever its name
    for name in ("sidebar", "menu content", "page-with-menu", "widget-area"):
        assert htmltext.main_text(f'<body><div class="{name}"><p>{STORY}</p><p>{STORY}</p></div><div><p>More</p></div></body>') == f"{STORY}\n{STORY}", name
    assert htmltext.main_text(f"<body><form><p>{STORY}</p></form></body>") == STORY
    # readers may write more than the author
    page = f'<body><div id="post"><p>{STORY}</p></div><div id="comments">' + f"<div><p>{P1}</p></div>" * 50 + "</div></body>"
    assert htmltext.main_text(page) == STORY


def test_marked_elements_in_the_line():
    """A sentence keeps what a name marks in it; a block of nothing else is judged like a marked block."""
    assert htmltext.main_text("<article><p>He wrote <span class='notice'>the public notice</span> on the wall</p></article>") == "He wrote the public notice on the wall"
    assert htmltext.main_text(f"<article><p>The <em class='related'>related</em> case, and <b id='ad'>an advert</b>.</p><p>{P1}</p></article>") == f"The related case, and an advert.\n{P1}"
    for alone in ("<span class='ad'>Buy now, all of you, and then again</span>", "<a class='share-link' href='/x'>Share</a> <a class='share-link' href='/y'>Post</a>", "<span class='notice'>Read <b>this</b></span>"):
        assert htmltext.main_text(f"<article><p>{P1}</p>{alone}<p>{P2}</p></article>") == f"{P1}\n{P2}", alone
        assert htmltext.main_text(f"<article><p>{P1}</p><p>See: {alone}</p></article>") == f"{P1}\nSee: " + re.sub("<[^>]*>", "", alone)
    assert htmltext.main_text(f"<article><p>{P1} <span class='notice' hidden>No.</span>{P2}</p></article>") == f"{P1} {P2}"


def test_sections_with_a_name():
    """A paragraph in a section that a name marks is part of the article, unless the name is one of adverts and the like."""
    about = "Social work, which began in the town, changed the lives of all of its people."
    for name in ("social", "related", "comment-free share", "alert", "toc"):
        assert htmltext.main_text(f"<article><p>{P1}</p><div class='{name}'><h2>Part</h2><p>{about}</p></div><p>{P2}</p><p>{P2}</p></article>") == f"{P1}\nPart\n{about}\n{P2}\n{P2}", name
    for name in ("ad", "newsletter", "cookie-notice", "comments"):
        assert htmltext.main_text(f"<article><p>{P1}</p><div class='{name}'><p>{about}</p></div><p>{P2}</p><p>{P2}</p></article>") == f"{P1}\n{P2}\n{P2}", name
    assert htmltext.main_text(f"<article><p>{P1}</p><div class='social'><p><a href='/x'>{about}</a></p></div><p>{P2}</p></article>") == f"{P1}\n{P2}"


def test_controls_stand_in_the_line():
    for tag in ("button", "select", "audio", "video", "canvas", "object", "map", "datalist"):
        assert htmltext.main_text(f"<article><p>{P1}</p><p>Press <{tag}>x</{tag}> to begin</p></article>") == f"{P1}\nPress to begin", tag
    assert htmltext.main_text(f"<article><p>Name:<input value='x'>or not</p><p>{P1}</p></article>") == f"Name: or not\n{P1}"


def test_sibling_articles():
    one, two = f"<article><p>{P1}</p><p>{P2}</p><p>{P1}</p></article>", f"<article><p>{P2} Two.</p></article>"
    for body in (one + two, f"<main>{one}{two}</main>", f"<div>{one}</div><div>{two}</div>"[: -len("</div>")].replace("</div><div>", "")):
        assert htmltext.main_text(f"<body>{body}</body>") == f"{P1}\n{P2}\n{P1}\n{P2} Two.", body
    # comments, teasers of links and adverts aren't siblings, whatever their element
    reader = f"<article class='comment'><p>{P2} Reader.</p></article>"
    teaser = f"<article><p><a href='/x'>{P2} Teaser.</a></p></article>"
    assert htmltext.main_text(f"<body>{one}{reader * 4}{teaser}<article class='promo'><p>{P2}</p></article></body>") == f"{P1}\n{P2}\n{P1}"
    assert htmltext.main_text(f"<body>{reader}</body>") == f"{P2} Reader."


def test_nesting_is_linear():
    import time

    for tag in ("div", "b", "p", "li", "td", "article", "section", "x-y"):
        began = time.time()
        assert htmltext.main_text(f"<{tag}>" * 50_000 + STORY + f"</{tag}>" * 50_000) == STORY, tag
        assert time.time() - began < 2, tag
    began = time.time()
    htmltext.main_text("<p title='" * 20_000 + '<a b="' * 20_000)
    assert time.time() - began < 2


def _best_by_recursion(root):
    """The chosen text of a tree (tag, children or text), each rule followed node by node."""
    nodes = []

    def walk(node, parent):
        nodes.append((node, parent))
        for c in node[1]:
            if not isinstance(c, str):
                walk(c, node)

    walk(root, None)
    up = {id(n): p for n, p in nodes}
    text = lambda n: [x for c in n[1] for x in ([c] if isinstance(c, str) else text(c))]
    points = {id(n): 0.0 for n, _ in nodes}
    for n, _ in nodes:
        for c in n[1]:
            if isinstance(c, str) and len(c) >= 25:
                at = n if n[0] == "div" else up[id(n)]
                for weight in (1, 2, 6, 9, 12):
                    if at is not None:
                        points[id(at)] += (1 + c.count(",") + min(len(c) / 100, 3)) / weight
                        at = up[id(at)]
    best = nodes[0][0]
    for n, _ in nodes:
        if points[id(n)] > points[id(best)]:
            best = n
    while up[id(best)] is not None and up[id(best)][0] not in ("body",) and points[id(up[id(best)])] >= 0.9 * points[id(best)]:
        best = up[id(best)]
    if up[id(best)] is None or best[0] == "body":
        return text(best)
    kept = []
    for c in up[id(best)][1]:
        if not isinstance(c, str):
            size = sum(map(len, text(c)))
            if c is best or (size and (points[id(c)] >= 0.2 * points[id(best)] > 0 or (c[0] == "p" and size > 80) or c[0] == "h1")):
                kept += text(c)
    return kept


def test_scoring_equals_brute_force_without_article():
    import random

    rng = random.Random(11)
    for _ in range(300):
        count = [0]

        def words(n):
            count[0] += 1
            return f"t{count[0]} " + " ".join(rng.choice(["stone,", "town", "keeper", "harbour", "light,"]) for _ in range(n)) + "."

        def tree(depth):
            kids = []
            for _ in range(rng.randint(1, 4)):
                if depth and rng.random() < 0.5:
                    kids.append(("div", tree(depth - 1)))
                else:
                    kids.append((rng.choice(["p", "p", "h1"]), [words(rng.choice([1, 2, 8, 20]))]))
            return kids

        body = ("body", tree(3))
        show = lambda n: f"<{n[0]}>" + "".join(c if isinstance(c, str) else show(c) for c in n[1]) + f"</{n[0]}>"
        assert htmltext.main_text(show(body)) == "\n".join(_best_by_recursion(body)), show(body)
