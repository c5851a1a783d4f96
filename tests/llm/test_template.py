from __future__ import annotations

import random

import pytest
from sparkwarden.llm.markup import read_page
from sparkwarden.llm.template import host_templates, main_texts, page_tokens, text_token, token_classes

SCHEMA = "page_id long, url string, html string, host string, texts string"


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in main_texts(df).collect()}


def test_marked_article(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
        "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy</div><div class=cookie-notice>We use</div>"
        "<article><header><h1>Head &amp; line</h1></header><p><b>One&nbsp;two<br>\n three<p>Four &lt;b&gt; &copy;</p><aside>Side</aside>"
        "<form><label>Mail</label><input></form><ul class='share-links'><li>Share</ul><section id='comments'><article>First!</article></section>"
        "<pre>a\n  b</pre><!-- hid <p>den --></article><div id='sidebar'>More</div><footer>&copy; x</footer>"
    )
    got = texts(spark, [(1, "http://h/1", html), (2, "http://h/2", None), (3, None, ""), (4, "no url", "plain &amp; text"), (4, "no url", "plain &amp; text")])
    want = "Head & line\nOne two three\nFour <b> ©\na b"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain & text", 12)}


def unmarked(k, rng):
    """No article element and no telling names: only the host's other pages tell what is template."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    paragraphs = [" ".join(word() for _ in range(30)) for _ in range(rng.randint(2, 5))]
    heading = " ".join(word() for _ in range(4))
    links = "".join(f"<li><a href='/{i}'>{word()}</a></li>" for i in range(rng.randint(3, 6)))
    page = (
        f"<html><head><title>{heading}</title></head><body><div class='x1'><div class='top'>Daily Paper</div><ul>{links}</ul></div>"
        f"<div class='x2'><h1>{heading}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>Read our rules before you write to us.</p></div>"
        "<div class='x3'><p>Printed and published by the same house as ever.</p></div></body></html>"
    )
    return (k, f"https://paper.example/{k}", page), "\n".join([heading, *paragraphs])


def test_template_of_a_host(spark):
    rng = random.Random(4)
    rows, want = zip(*(unmarked(k, rng) for k in range(30)))
    got = texts(spark, rows)
    assert [got[k][0] for k in range(30)] == list(want)
    template = host_templates(spark.createDataFrame(list(rows), "page_id long, url string, html string")).collect()
    assert len(template) == 1 and template[0]["pages_of_host"] == 30 and template[0]["main_path"].endswith("div.x2")
    # The three lines that never change are template, and so are the tags around them.
    assert len(template[0]["texts"]) == 3 and template[0]["classes"] >= 1


def test_copies_of_an_article_are_no_template(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Same</h1><p>Copied on every page.</p></article></body></html>"
    got = texts(spark, [(k, f"http://mirror/{k}", page) for k in range(20)])
    assert set(got.values()) == {("Same\nCopied on every page.", 26)}


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("differing", [False, True])
def test_copies_in_any_tag_stay_whole(spark, tag, differing):
    """The same article on most pages of a host, alone or among lines that differ, is an article still."""
    page = "<html><body><nav>Menu</nav><{0}><h1>Same old story</h1><p>Copied on every page of the host, word by word.</p>{1}</{0}></body></html>"
    rows = [(k, f"http://mirror/{k}", page.format(tag, f"<p>Copy {k}.</p>" if differing else "")) for k in range(4)]
    got = texts(spark, rows)
    for k in range(4):
        assert got[k][0] == "Same old story\nCopied on every page of the host, word by word." + (f"\nCopy {k}." if differing else "")


def noticed(k, rng):
    paragraphs = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25)) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = (
        f"<html><body><article><p>Please keep our rules in mind.</p>{body}<div class='related-work'><p>Others found {k}.</p></div>"
        "<p>All rights reserved by the paper.</p></article></body></html>"
    )
    return (k, f"https://notices.example/{k}", page), "\n".join([*paragraphs, f"Others found {k}."])


@pytest.mark.parametrize("repeats", [1, 2])
def test_notices_inside_articles_are_template(spark, repeats):
    """Two lines stand in every article of the host: they go, also when all rows are there twice."""
    rng = random.Random(5)
    rows, want = zip(*(noticed(k, rng) for k in range(12)), strict=True)
    got = texts(spark, list(rows) * repeats)
    assert [got[k][0] for k in range(12)] == list(want)
    alone = texts(spark, [(k, None, html) for k, _, html in rows])
    assert all(alone[k][0] == "\n".join(["Please keep our rules in mind.", want[k], "All rights reserved by the paper."]) for k in range(12))


def test_classes_against_brute_force(spark):
    """Tokens are in one class exactly if they stand equally often in every page of different content."""
    rng = random.Random(6)
    pages = []
    for k in range(25):
        lines = [f"<p>line {i}</p>" * rng.choice([0, 1, 1, 2]) for i in range(6)]
        fixed = "<p>always</p><p>too</p>"
        pages.append((k, f"http://h/{k}", f"<div><b>{fixed}</b>{''.join(lines)}<p>own {k % 20}</p></div>"))
    df = spark.createDataFrame(pages + pages[:9], "page_id long, url string, html string")
    vectors = {}
    for content in {tuple(b.text for b in read_page(h)[1]): h for _, _, h in pages}.items():
        for b in read_page(content[1])[1]:
            token = text_token(b)
            vectors.setdefault(token, {}).setdefault(content[0], 0)
            vectors[token][content[0]] += 1
    found = {}
    for r in token_classes(page_tokens(df)).where("kind = 1").collect():
        found.setdefault(r["class"], set()).add(r["token"])
        assert r["pages"] == len(vectors[r["token"]]) and r["occurrences"] == sum(vectors[r["token"]].values())
    grouped = {}
    for members in found.values():
        for token in members:
            grouped[token] = frozenset(members)
    for a in grouped:
        for b in grouped:
            assert (vectors[a] == vectors[b]) == (b in grouped[a])
    assert any(len(g) > 1 for g in grouped.values())


def test_names_and_formulas(spark):
    page = (
        "<article><p>One</p><div class='legal-history'>Two</div><p class='alert'>Gone</p><div class='share-links'>Gone</div>"
        "<p>E is <math><mi>m</mi><mo>c</mo></math></p><div id='reply_to_critics'><p>Three</p></div><div class='comments-list'>Gone</div></article>"
    )
    assert texts(spark, [(1, "http://h/1", page)])[1][0] == "One\nTwo\nE is mc\nThree"


def test_table_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = main_texts(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    ["<", "<p", "<div class=\"a>b", "</p></div>", "<script>never ends <p>", "a < b > c", "<!-- open", "<p class='x' \"", "&#x41;&bogus;&amp", "<a><a></a>x", "<table><tr><td>1<td>2<tr><td>3"],
)
def test_broken_markup_is_read(html):
    tags, blocks = read_page(html)
    assert isinstance(tags, list) and all(b.text for b in blocks)


def test_long_pages_are_read_whole():
    html = "<article>" + "<p>word word</p>" * 50000 + "</article>"
    assert len(read_page(html)[1]) == 50000
    assert len(read_page("<div>" * 3000 + "deep")[1]) == 1
