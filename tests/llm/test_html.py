"""Main text: regions by clusters, malformed pages, and a second, slow implementation."""

from __future__ import annotations

import math
import random
import re
import time

import pytest

from posegrid.llm import html_extract

LONG = "This paragraph has a good many words in it, so that its ratio of text to tags is high."
OTHER = "A second paragraph that is about as long as the first, with other words to tell them apart."
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page, wanted",
    [
        (f"<body><article>{LINKS}</article><div><p>{LONG}</p><p>{OTHER}</p></div></body>", f"{LONG}\n{OTHER}"),  # a teaser article is no region
        (f"<body><article><p>{LONG}</p></article><article><p>{OTHER}</p><p>Short.</p></article></body>", f"{LONG}\n{OTHER}\nShort."),
        (f"<body>{LINKS}<div><div><p>{LONG}</p><p>Short.</p><p>{OTHER}</p></div></div>{LINKS}</body>", f"{LONG}\nShort.\n{OTHER}"),
        (f"<article><p>One <svg><path d=x/><circle r=1 /></svg>two</p><svg/><p>{LONG}</p></article>", f"One two\n{LONG}"),
        (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be it. <button>Go</button> And on.</p><p>{LONG}</p></article>", f"Let x=1 be it. And on.\n{LONG}"),
        (f"<article><div class=popular><p>{LONG}</p></div><p class=legal>{OTHER}</p><section id=discussion><p>End.</p></section></article>", f"{LONG}\n{OTHER}\nEnd."),
        (f"<div><p>{LONG}</p><p><a href=x>{OTHER}</a></p><p>{LONG}</p></div>", f"{LONG}\n{OTHER}\n{LONG}"),  # full of links, but clustered
        (f"<article><p>{LONG}</p><![if x]><p>Seen</p><![endif]><!-- not <b>this --><p>{OTHER} <a href=", f"{LONG}\nSeen\n{OTHER}"),
        ("<nav>Menu only</nav><footer>Imprint</footer>", ""),
        ("", ""), (None, ""), ("plain text, no tag", "plain text, no tag"),
    ],
)
def test_regions(page, wanted):
    assert html_extract.extract(page) == wanted


def test_clusters_decide(monkeypatch):
    page = f"<body><div>{LINKS}<p>Advice</p></div><div><p>{LONG}</p><p>{OTHER}</p></div></body>"
    before = html_extract.extract(page)
    monkeypatch.setattr(html_extract, "content_lines", lambda ratios: [True] * len(ratios))
    assert before == f"{LONG}\n{OTHER}" != html_extract.extract(page)


@pytest.mark.parametrize("piece", ["<a ", "<![x ", "<!-- ", "<!", "</a ", "<?", "&#", "<script>", "<![CDATA[", '<a b="', "<a b='c\" ", "<", "</", "<svg/>", "<svg>", "<p>", "<b>", "<td><table>"])
def test_malformed_is_linear(piece):
    began = time.perf_counter()
    html_extract.extract(f"<p>{LONG}</p>" + piece * 20_000)
    assert time.perf_counter() - began < 5


def test_fuzz():
    r = random.Random(3)
    pieces = ["<p>", "</p>", "<div class=ad>", "</div>", "<![", "]]>", "<!--", "-->", "<svg", "/>", ">", "<", "&amp;", "&#x41", "text ", '"', "'", "=", "<script>", "</script>", "<a href=", "</", "<?", "\x00", "é", "<article>", "</article>", "<head>", "<title>"]
    for _ in range(3000):
        assert isinstance(html_extract.extract("".join(r.choices(pieces, k=r.randint(1, 30)))), str)


def slow(page: str) -> str:
    """The method over well-formed pages of body, article, div, nav, ul, li, p and a, by recursion over a tree."""
    lines, nodes = [], [("", None)]
    at, tags, path, text, linked, in_a = 0, 0, [0], "", 0, False

    def flush():
        nonlocal tags, text, linked
        clean = re.sub(r"\s+", " ", text).strip()
        if clean:
            lines.append((clean, tags, min(linked, len(clean)), list(path), any(nodes[n][0] == "nav" for n in path)))
            tags = 0
        text, linked = "", 0

    for close, tag, data in re.findall(r"<(/?)(\w+)[^>]*>|([^<]+)", page):
        if data:
            text += data
            linked += len(data) if in_a else 0
            continue
        tags += 1
        if tag == "a":
            in_a = not close
            continue
        flush()
        if close:
            path.pop()
        else:
            nodes.append((tag, path[-1]))
            path.append(len(nodes) - 1)
    flush()
    ratios = [len(t) / max(n, 1) for t, n, *_ in lines]
    smooth = []
    for i in range(len(ratios)):
        ws = {k: math.exp(-((k - i) ** 2) / 2) for k in range(len(ratios)) if abs(k - i) <= 3}
        smooth.append(sum(w * ratios[k] for k, w in ws.items()) / sum(ws.values()))
    mean = sum(smooth) / len(smooth) if smooth else 0
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)) if smooth else 0
    ok = [x >= 0.5 * spread for x in smooth]
    gain = [sum(-len(t) if part else len(t) if k else -(a + 0.2 * (len(t) - a)) for (t, _, a, p, part), k in zip(lines, ok) if n in p) for n in range(len(nodes))]
    above = lambda n: [] if n is None else [n, *above(nodes[n][1])]
    articles = [n for n in range(len(nodes)) if nodes[n][0] == "article" and not any(nodes[m][0] in ("article", "nav") for m in above(n)[1:]) and gain[n] > 0]
    best = max(range(len(nodes)), key=lambda n: (gain[n], n))
    if articles and sum(gain[n] for n in articles) >= 0.5 * gain[best]:
        chosen = articles
    else:
        top = gain[best]
        while nodes[best][0] in ("p", "li"):
            best = nodes[best][1]
        while True:
            below = sorted((n for n in range(len(nodes)) if nodes[n][1] == best), key=lambda n: (-gain[n], n))
            if not below or gain[below[0]] < 0.85 * top or nodes[below[0]][0] in ("p", "li"):
                break
            best = below[0]
        chosen = [best]
    sure = lambda p: any(nodes[n][0] == "article" for n in p)
    return "\n".join(t for (t, _, a, p, part), k in zip(lines, ok) if not part and set(p) & set(chosen) and (sure(p) or k or a <= 0.6 * len(t)))


def test_against_slow():
    r = random.Random(12)
    say = lambda a, b: " ".join(r.choices(["word", "of", "longer", "texts", "é"], k=r.randint(a, b)))

    def block(depth: int) -> str:
        kind = r.choice(["p", "p", "p", "div", "article", "nav", "ul"] if depth < 4 else ["p"])
        if kind == "p":
            return f"<p>{say(1, 4) if r.random() < 0.3 else say(10, 60)}{f'<a href=x>{say(1, 5)}</a>' if r.random() < 0.3 else ''}</p>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a href=x>{say(1, 3)}</a></li>" for _ in range(r.randint(1, 8))) + "</ul>"
        return f"<{kind}>" + "".join(block(depth + 1) for _ in range(r.randint(1, 4))) + f"</{kind}>"

    seen = set()
    for _ in range(400):
        page = "<body>" + "".join(block(0) for _ in range(r.randint(1, 6))) + "</body>"
        got = html_extract.extract(page)
        assert got == slow(page), page
        seen.add(got)
    assert len(seen) > 300


def test_edges(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, "y"), (1, "u", f"<p>{LONG}</p>", "x"), (2, "v", "<p>" + "w " * 200_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((x["page_id"] or 0, x["n_chars"]) for x in html_extract.extract_pages(df).collect())
    assert got == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 399_999)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0
