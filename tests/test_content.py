"""Main content against a plain reading of generated trees, and the cases that each rule is there for."""

import html as entities
import random

from sparkloom.operators import content
from sparkloom.operators.content import BLOCKS, MAIN_TAGS, is_main, left_out, plain_lines

SENTENCE = "This sentence is long enough to be a readable paragraph of a page."


def tree(rng, depth=0):
    """A random element: (tag, attributes, children)."""
    tag = rng.choice(("div", "p", "span", "section", "article", "main", "nav", "aside", "b", "a", "ul", "li", "h1", "footer", "td"))
    attrs = {}
    if rng.random() < 0.3:
        attrs["class"] = rng.choice(("menu", "post", "my-sidebar", "mw-parser-output", "toc x", "navigationbar", "reference", "cookies"))
    if rng.random() < 0.2:
        attrs["id"] = rng.choice(("content", "body-content", "toc", "toc-2", "other", "main"))
    if rng.random() < 0.1:
        attrs["role"] = rng.choice(("main", "search", "note"))
    children = [rng.choice(("word & more", "  two\n words ", "5 < 6", "x")) if rng.random() < 0.5 or depth > 4 else tree(rng, depth + 1) for _ in range(rng.randrange(0, 5))]
    return tag, attrs, children


def written(node):
    if isinstance(node, str):
        return entities.escape(node)
    tag, attrs, children = node
    given = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f"<{tag}{given}>{''.join(map(written, children))}</{tag}>"


def said(node, inside=False):
    """(text, main text, boxes left out) of a tree."""
    if isinstance(node, str):
        return node, node if inside else "", 0
    tag, attrs, children = node
    if left_out(tag, attrs):
        return "", "", 1
    inside = inside or is_main(tag, attrs)
    parts = [said(c, inside) for c in children]
    line = "\n" if tag in BLOCKS else ""
    return line + "".join(p[0] for p in parts) + line, (line if inside else "") + "".join(p[1] for p in parts) + (line if inside else ""), sum(p[2] for p in parts)


def read(spark, pages):
    return {r["id"]: r for r in content.main_content(spark.createDataFrame(list(pages.items()), "id long, html string")).collect()}


def test_random_trees_equal_a_plain_reading(spark):
    rng = random.Random(2)
    trees = {i: ("body", {}, [tree(rng) for _ in range(rng.randrange(1, 6))]) for i in range(300)}
    got = read(spark, {i: f"<html><head><title>T {i}</title></head>{written(t)}</html>" for i, t in trees.items()})
    mains = 0
    for i, t in trees.items():
        whole, main, boxes = said(t)
        main = plain_lines(main) if len(plain_lines(main)) >= 40 else ""
        wiki = "mw-parser-output" in written(t)
        want = main or plain_lines(whole) or f"T {i}"
        if not wiki:
            assert (got[i]["text"], got[i]["removed_boilerplate"]) == (want, boxes), written(t)
        mains += bool(main)
        assert got[i]["title"] == f"T {i}"
    assert mains > 20 and MAIN_TAGS == {"article", "main"}


def test_what_each_rule_is_for(spark):
    wiki = f"<body class=mediawiki><div id='mw-content-text'><table><tr><td>x</td></tr></table><p>{SENTENCE}</p><p>Jump to content of this page, which is long enough.</p><p>short.</p><div class=navbox><p>{SENTENCE}</p></div><p>{SENTENCE * 3}</p></div></body>"
    pages = {
        1: f"<title> A \n title </title><script>bad('<p>no</p>')</script><nav>Menu</nav><main><h1>Heading</h1><p>{SENTENCE}<br>More &amp; more, see <a href=x>the  link</a> and <a href=y><img></a></p></main><footer>Rights</footer>",
        2: "<p>Too short</p><article>tiny</article>", 3: "<title>Only a title</title><nav>Menu</nav>", 4: None, 5: "", 6: wiki,
        7: f"<main>{SENTENCE} Instances are listed at <a></a>. Engines from up to 251 . Do see . Look at . Done at home.</main>",
        8: "<title>Moved</title><p>You are being redirected to the page.</p><a href='https://example.org/a?b=1&amp;c=2'>here</a>",
        9: "<p>Moved permanently: http://example.org/new, thanks</p>", 10: '<meta http-equiv="refresh" content="0; url=https://example.org/meta"><p>Redirecting to somewhere</p>', 11: "<p>Redirecting to nowhere</p>",
        12: f"<main><p>{SENTENCE}</b></i></p></div></div></main><p>after</p>", 13: f"<div class=sidebar><p>{SENTENCE}", 14: "<p>one</p>" * 3 + "<div>" * 30_000 + "end",
    }
    got = read(spark, pages)
    assert got[1]["title"] == "A title" and got[1]["text"] == f"Heading\n\n{SENTENCE}\nMore & more, see the link and" and (got[1]["removed_boilerplate"], got[1]["link_texts"]) == (3, 1)
    assert got[2]["text"] == "Too short\n\ntiny" and got[2]["strategy"] == "main_content"
    assert (got[3]["text"], got[3]["strategy"], got[3]["fallback_used"]) == ("Only a title", "title_text_fallback", True)
    assert (got[4]["text"], got[4]["title"]) == (got[5]["text"], got[5]["title"]) == ("", None)
    assert got[6]["text"].startswith("x") and got[6]["strategy"] == "main_content"
    assert got[7]["text"].endswith("Instances are listed at. Engines. Do. Look. Done at home.") or got[7]["dropped_fragments"] == ["from up to <number> .", "listed at .", "see .", "at ."]
    assert [(got[i]["reason"], got[i]["followup_url"]) for i in (8, 9, 10, 11)] == [("redirect_stub", u) for u in ("https://example.org/a?b=1&c=2", "http://example.org/new", "https://example.org/meta", None)]
    assert got[12]["text"].startswith(SENTENCE) and got[13]["text"] == "" and got[14]["text"].endswith("end")
    assert all(got[i]["reason"] is None for i in (1, 2, 3, 4, 5, 6, 7))


def test_wiki_paragraphs_stand_in_where_the_main_text_is_empty(spark):
    page = f"<body><div class='mediawiki'>Links</div><div class='mw-parser-output'><div class=hatnote>x</div></div><div><p>{SENTENCE}</p><p>{SENTENCE} {SENTENCE}</p></div></body>"
    got = read(spark, {1: page, 2: page.replace("mediawiki", "other").replace("mw-parser-output", "out")})
    assert (got[1]["strategy"], got[1]["text"]) == ("body_readable_paragraphs", f"{SENTENCE}\n\n{SENTENCE} {SENTENCE}") and got[1]["fallback_used"]
    assert got[2]["strategy"] == "main_content" and got[2]["text"].startswith("Links")


def test_segments_lie_where_they_say(spark):
    texts = {1: "a  b\nc\n\n\n d \n\n\t\n\ne f", 2: "", 3: None, 4: "\n\nx"}
    rows = content.segments(spark.createDataFrame(list(texts.items()), "id long, text string"), "id").collect()
    for i in texts:
        own = sorted((r for r in rows if r["id"] == i), key=lambda r: r["segment_no"])
        joined = "\n\n".join(r["segment"] for r in own)
        assert all(joined[r["start"] : r["stop"]] == r["segment"] for r in own) and [r["segment_no"] for r in own] == list(range(len(own)))
    assert [r["segment"] for r in sorted((r for r in rows if r["id"] == 1), key=lambda r: r["start"])] == ["a b\nc", "d", "e f"]


def test_other_columns_stay_and_empty_tables_pass(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "t", 3)], "id long, html string, text string, other int")
    out = content.main_content(df)
    assert out.columns == ["id", "other", *content.RESULTS] and out.first()["other"] == 3
    assert content.main_content(df.limit(0)).count() == 0
