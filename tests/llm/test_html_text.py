import math
import random
from xml.etree import ElementTree

import numpy as np
import pyarrow.parquet as pq
import pytest

from vaultspark.llm import html_text

LONG = "A paragraph of some length that reads like the text of an article and goes on for a while."
PAGE = f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";x(0);</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">{LONG}</div>
<article><h1>Head &amp; line</h1><p><b>Open bold<br><p>{LONG}</p><p>Short.</p><div class="cookie-notice">{LONG}</div><form><input>Search</form>
<ul><li>one</li><li>two&nbsp; 2</li></ul><section id="comments"><p>{LONG}</p></section></article><aside>{LONG}</aside><footer>&copy; x</footer></body></html>"""


def test_article_without_boxes():
    assert html_text.extract(PAGE).split("\n") == ["Head & line", "Open bold", LONG, "Short.", "one", "two 2"]


def test_page_without_article_element():
    page = f"<body class='has-sidebar'><div class=menu><a href=#>Home</a></div><div id=wrap><div class=content><h2>Title</h2><p>{LONG}<p>Short &amp; sweet.<p>{LONG}</div><div class=sidebar><p>{LONG}</div></div><footer>c</footer>"
    assert html_text.extract(page).split("\n") == ["Title", LONG, "Short & sweet.", LONG]


def test_unclosed_boxes_do_not_hold_the_article():
    assert html_text.extract(f"<nav><ul><li>Menu<article><p>{LONG}</p>") == LONG


def test_empty_null_and_plain():
    assert [html_text.extract(x) for x in (None, "", "   ", "<p></p>", "<script>x</script>", "<script>never closed")] == [""] * 6
    assert html_text.extract("just text &lt;here") == "just text <here"
    assert html_text.extract("<p>" + "word " * 100_000).count("word") == 100_000


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(df).collect())
    assert [g[0] for g in got] == [1, 1, 2] and got[2][1] == "" and got[0][1].startswith("Head & line")
    assert html_text.main_text(df.limit(0)).count() == 0


def plain_marks(ratios, sigma=1.5):
    """Ratios smoothed and clustered by loops over the definition."""
    ratios = [min(html_text.FULL, x) for x in ratios]
    wide = []
    for i in range(len(ratios)):
        near = [(math.exp(-((i - j) ** 2) / (2 * sigma**2)), ratios[j]) for j in range(len(ratios)) if abs(i - j) <= 3]
        wide.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    low, high = min(wide), max(wide)
    while True:
        below, above = [x for x in wide if x < (low + high) / 2], [x for x in wide if x >= (low + high) / 2]
        if not below or (sum(below) / len(below), sum(above) / len(above)) == (low, high):
            return [x >= (low + high) / 2 for x in wide]
        low, high = sum(below) / len(below), sum(above) / len(above)


def test_marks_equal_the_plain_definition():
    r = random.Random(4)
    for _ in range(300):
        lines = [("x" * r.choice((3, 20, 200)), r.randint(1, 9)) for _ in range(r.randint(1, 30))]
        assert html_text.marks(lines).tolist() == plain_marks([len(t) / n for t, n in lines])


LINKS = "".join(f"<li><a href=/{i}><b>Go {i}</b></a></li>" for i in range(12))


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div><div><ul>{LINKS}</ul></div><div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><div><ul>{LINKS}</ul></div></div>", [LONG, "Short.", LONG]),
        (f"<body><article><p><a href=/><b>More</b></a></p></article><ul>{LINKS}</ul><div><p>{LONG}</p><p>{LONG}</p></div><ul>{LINKS}</ul>", [LONG, LONG]),
        (f"<body><ul>{LINKS}</ul><article><p>{LONG * 9}</p></article><article><p>{LONG}</p></article><ul>{LINKS}</ul>", [LONG * 9, LONG]),
        (f"<body><ul>{LINKS}</ul><div><p>{LONG}</p><p>{LONG}</p></div><article><ul>{LINKS}</ul></article><ul>{LINKS}</ul>", [LONG, LONG]),
    ],
)
def test_clustering_chooses_the_region(page, want, monkeypatch):
    assert html_text.extract(page).split("\n") == want


def test_pages_change_without_clustering(monkeypatch):
    page = f"<body><div><div><ul>{LINKS}</ul></div><div><div><p>{LONG}</p><p>Short.</p></div></div></div>"
    whole = html_text.extract(page)
    monkeypatch.setattr(html_text, "marks", lambda lines: np.ones(len(lines), bool))
    assert whole.split("\n") == [LONG, "Short."] and html_text.extract(page) != whole


BODY = " ".join(f"word{k}" for k in range(300))
WRAPPERS = "elementor-widget-container widget-content header-text post-share-body comment-free legal-article tags-post reply-to-critics modal-logic social-history rail-journey".split()


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "div", "form"])
def test_a_wrapper_s_class_name_does_not_lose_the_article(name, tag):
    page = f"<body><nav><ul>{LINKS}</ul></nav><{tag}><h1>Title</h1><div class='{name}'><p>{BODY[:900]}</p><p>Short.</p><p>{BODY[900:]}</p></div><div class='comments'><p>{LONG}</p></div></{tag}><footer>c</footer>"
    assert html_text.extract(page).split("\n") == ["Title", BODY[:900].strip(), "Short.", BODY[900:].strip()]


def test_many_wrappers_of_one_name_and_real_boxes_beside_them():
    parts = "".join(f"<div class='site-widget-body'><p>{k} {LONG}</p></div>" for k in range(6))
    page = f"<body><div class='cookie-notice'><p>{LONG}</p></div><h1>Title</h1>{parts}<div id='comments'><p>{BODY}</p></div>"
    assert html_text.extract(page).split("\n") == ["Title", *[f"{k} {LONG}" for k in range(6)]]


def test_articles_stay_however_short():
    assert html_text.extract(f"<body><article><p>{LONG * 9}</p></article><article><p>Short second story.</p></article>").split("\n") == [LONG * 9, "Short second story."]


def test_what_is_not_shown_never_counts():
    assert html_text.extract(f"<body><div hidden><p>{BODY}</p></div><div style='display: none'><p>{BODY}</p></div><p>Seen.</p>") == "Seen."


def plain_extract(page):
    """Main text of a well-formed page, from its tree: an own walk, and the rules of the docstring by their words."""
    lines, names = [], {}

    def walk(node, path, keys, article, main):
        if node.tag in ("script", "style"):
            return
        keys = keys | {k for k in html_text.boxes(node.tag, list(node.attrib.items()))}
        article, main = article or node.tag == "article", main or node.tag == "main"
        if node.tag in html_text.REGIONS:
            path = [*path, node]
        names[node] = node.tag
        tags[0] += 1
        at(path, keys, article, main, node.text)
        for child in node:
            walk(child, path, keys, article, main)
            at(path, keys, article, main, child.tail)

    def at(path, keys, article, main, text):
        if text and text.strip():
            lines.append((" ".join(text.split()), tags[0], path, keys, article, main))  # random pages hold no headings
            tags[0] = 0

    tags = [0]
    walk(ElementTree.fromstring(page), [], set(), False, False)
    if not lines:
        return ""
    marked = plain_marks([len(x[0]) / max(1, x[1]) for x in lines])
    on = set().union(*[x[3] for x in lines])
    total = sum(len(x[0]) for x, m in zip(lines, marked) if m)
    under = lambda k: sum(len(x[0]) for x, m in zip(lines, marked) if m and k in x[3])
    while True:
        left = sum(len(x[0]) for x, m in zip(lines, marked) if m and not x[3] & on)
        maybe = [k for k in on if k[0] == html_text.MAYBE and under(k) >= total / 10]
        sure = [k for k in on if k[0] == html_text.SURELY and under(k)]
        choice = maybe if left < total / 10 and maybe else sure if not left else []
        if not choice:
            break
        on -= {max(choice, key=lambda k: (under(k), k))}
    kept = [(x, m) for x, m in zip(lines, marked) if not x[3] & on]
    base = [x for x, m in kept if m] or [x for x, _ in kept]
    whole = sum(len(x[0]) for x in base)
    if sum(len(x[0]) for x in base if x[4]) >= 0.8 * whole:
        return "\n".join(x[0] for x, _ in kept if x[4])
    holders = [r for r in names if r.tag in html_text.REGIONS and sum(len(x[0]) for x in base if r in x[2]) >= 0.8 * whole]
    inside = [x for x, _ in kept if not holders or holders[-1] in x[2]]
    for outer in reversed(next(x[2] for x in inside)[: next(x[2] for x in inside).index(holders[-1])] if holders else []):
        wider = [(x, m) for x, m in kept if outer in x[2]]
        if not all(m for x, m in wider if x not in inside):
            break
        inside = [x for x, _ in wider]
    if all(x[5] for x in inside):
        inside = [x for x, _ in kept if x[5]]
    return "\n".join(x[0] for x in inside)


def random_page(r):
    def text(kind):
        n = {"menu": 1, "short": r.randint(1, 6), "long": r.randint(20, 150)}[kind]
        return " ".join("w" * r.randint(1, 9) for _ in range(n))

    def block(depth, inside=""):
        kind = r.random()
        if depth > 3 or kind < 0.4:
            return f"<p>{text(r.choice(['short', 'long', 'long']))}</p>"
        if kind < 0.55:
            return "<ul>" + "".join(f"<li>{text('menu')}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
        tag = r.choice(["div", "div", "div", "section", "nav", "aside", "footer", "form", *["article", "main"] * (inside != "nav")])  # an article right inside a menu ends the menu
        name = r.choice(["", "", "", " class='ad'", " class='comments'", " class='widget-content'", " class='post-share-body'", " id='sidebar'", " role='banner'", " class='wrap'"])
        return f"<{tag}{name}>" + "".join(block(depth + 1, tag) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    return "<html><body>" + "".join(block(0) for _ in range(r.randint(1, 5))) + "</body></html>"


def test_extraction_equals_a_plain_walk_of_the_tree():
    r = random.Random(11)
    pages = [random_page(r) for _ in range(400)]
    got, want = [html_text.extract(p) for p in pages], [plain_extract(p) for p in pages]
    assert sum(g != "" for g in got) > 300
    assert got == want


def test_marks_decide_on_varied_pages(monkeypatch):
    """With the opposite marks, and with all lines marked, results differ on many pages, the tables' pages among them."""
    r = random.Random(12)
    pages = [random_page(r) for _ in range(100)]
    tables = [x["html"] for x in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    plain, own = [html_text.extract(p) for p in pages], [html_text.extract(p) for p in tables]
    real = html_text.marks
    monkeypatch.setattr(html_text, "marks", lambda lines: ~real(lines))
    assert sum(html_text.extract(p) != w for p, w in zip(pages, plain)) > 30
    assert sum(html_text.extract(p) != w for p, w in zip(tables, own)) > 0
    monkeypatch.setattr(html_text, "marks", lambda lines: np.ones(len(lines), bool))
    assert sum(html_text.extract(p) != w for p, w in zip(pages, plain)) > 10


def test_repeated_pages_and_clashing_names(spark):
    df = spark.createDataFrame([(1, PAGE, "old", 1), (1, PAGE, "old", 2), (2, "", None, 3), (3, "<p>" + "long " * 200_000, "x", 4)], "page_id long, html string, text string, run int")
    got = {r.run: r.text for r in html_text.main_text(df).collect()}
    assert got[1] == got[2] == html_text.extract(PAGE) and got[3] == "" and got[4].count("long") == 200_000
