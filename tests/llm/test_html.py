import time

from joblode.llm.html_blocks import blocks
from joblode.llm.html_pages import labelled_pages
from joblode.llm.html_text import TRAINING_PAGES, main_text, path_features, train
from web_pages import PAGES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept them.</div>
<article><h1>A &amp; B&nbsp; title</h1><p>First  paragraph\n of the &lt;text&gt;, which is long enough.<p>Second one, with <b>bold</b> words &#233; here.<br>And more.
<div class="ad">Buy this thing now.</div><script>var t="</p>";</script><p>Third paragraph ends the text.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not like this at all.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>One more story</a></li></ul></aside>
<form class="newsletter"><label>Mail</label><button>Go</button></form>
<footer>&copy; 2024 Somebody</footer></body></html>"""
TEXT = "A & B title\n\nFirst paragraph of the <text>, which is long enough.\n\nSecond one, with bold words é here. And more.\n\nThird paragraph ends the text."


def test_blocks_of_broken_markup():
    assert [b.text for b in blocks("<p>one<p>two<li>three</ul></div>four<b>five<!-- x -->six")] == ["one", "two", "three", "fourfivesix"]
    assert [b.text for b in blocks("<script>never ends <p>x")] == []
    assert [b.text for b in blocks("a < b <p class='x>y'>c</p")] == ["a < b", "c"]
    assert blocks("") == [] and blocks("<p> </p>") == []


def test_deep_and_unclosed_markup_takes_linear_time():
    """Nested, unclosed and unmatched elements by the ten thousands, and a page of 20 MB."""
    model = train(labelled_pages(60), rounds=10)
    for page, n in (
        ("<div class=a>x" * 50_000, 50_000), ("<h1>x" * 50_000, 50_000), ("<title>x" * 50_000, 1), ("<div>x" * 20_000 + "</p>" * 50_000, 20_000), ("<p>x" * 50_000, 50_000), ("<li><i>x" * 50_000, 50_000),
        ("<textarea>" * 50_000, 0), ("</div>" * 50_000 + "x", 1), ("<article><p>" + "words of text " * 1_500_000, 1),
    ):
        begin = time.process_time()
        found = blocks(page)
        assert len(found) == n and len(model.decode(found)) == n
        assert time.process_time() - begin < 15


def test_path_features_are_those_of_all_ancestors():
    found = blocks('<div class="a b"><section id=a><div class=c>x</div><p>y</p></section>z</div>')
    assert [sorted(path_features(b.inside)) for b in found] == [
        sorted(["b:div", "t0:div", "t1:section", "t:div", "t:section", "c:a", "c:b", "c:c"]), sorted(["b:p", "t0:p", "t1:section", "t:div", "t:section", "t:p", "c:a", "c:b"]), sorted(["b:div", "t0:div", "t:div", "c:a", "c:b"]),
    ]


def test_held_out_accuracy():
    model = train(labelled_pages(500), rounds=80)
    wrong = total = 0
    for page in labelled_pages(150, seed=77):
        found = blocks(page)
        wrong += sum(y != b.main for b, y in zip(found, model.decode(found)))
        total += len(found)
    assert wrong < 0.02 * total
    assert model.text(PAGE) == TEXT
    best = model.decode(blocks(PAGE))
    assert best == viterbi(model, blocks(PAGE))


def test_pages_that_the_generator_did_not_write():
    """By characters of blocks: nothing of the main text is lost; the table layout without names keeps its menu."""
    model = train(labelled_pages(TRAINING_PAGES))
    right = extra = lost = 0
    for html, want in PAGES:
        got = model.text(html).split("\n\n")
        right += sum(len(x) for x in got if x in want)
        extra += sum(len(x) for x in got if x not in want)
        lost += sum(len(x) for x in want if x not in got)
    assert right > 0.97 * (right + lost) and right > 0.93 * (right + extra)


def viterbi(model, page):
    """The best labelling among all, by dynamic programming over plain lists of paths."""
    paths = [(model.start[y] + y * model.unary(page[0]), [y]) for y in (0, 1)]
    for b in page[1:]:
        u = model.unary(b)
        paths = [max((s + model.steps[p[-1]][y] + y * u, [*p, y]) for s, p in paths) for y in (0, 1)]
    return max(paths)[1]


def test_nulls_and_repeats(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, None), (None, "u", "", 1), (3, "u", "<html></html>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text(df).collect())
    assert got == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0), (3, "", 0)]
    assert main_text(df.limit(0)).collect() == []
