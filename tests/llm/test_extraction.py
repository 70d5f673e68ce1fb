import html
import random
import re
import time

from llm_helpers import plain
from tramline.llm import crf, dom, extraction
from tramline.llm.catalog import QUERIES

PAGE = """<html><body><header><h1>My Site</h1></header><div id="cookie-banner"><p>We use cookies to improve.</p></div>
<div class="content"><h1>Title here</h1><p>First &amp; para<sup>1</sup> of   text with a < b sign.</p>
<div class="ad">Buy now cheap stuff today</div><p>Second para is here, and it goes on for long.</p></div>
<aside class="sidebar"><p>Sidebar text that is long enough to seem real, right.</p></aside>
<section class="comments"><p>I think that this article is great, and I learned a lot from it.</p></section>
<form><label>Name</label><input></form><footer>Copyright</footer>"""


def article(page):
    """Text of the one article in the supplied pages, whose markup is plain."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", inside)]
    return "\n\n".join(p for p in parts if p)


def test_supplied_pages(spark):
    rows = QUERIES["op3_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    right = sum(r["text"] == article(pages[r["page_id"]]) for r in rows)
    assert len(rows) == len(pages) and right >= 0.99 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_other_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    chain = extraction.trained(pages)
    assert extraction.main_text(PAGE, chain)[0].split("\n\n") == [
        "Title here", "First & para1 of text with a < b sign.", "Second para is here, and it goes on for long."]
    rng = random.Random(77)
    texts = [extraction.invented(rng, rng.randint(5, 60)) for _ in range(80)]
    hit = said = true = 0
    for _ in range(150):
        found = dom.blocks(extraction.composed(rng, texts, ["one", "two more"]))
        got, told = chain.best(*extraction.features(found)), [b.label or 0 for b in found]
        hit, said, true = hit + sum(a & b for a, b in zip(got, told)), said + sum(got), true + sum(told)
    assert hit / said > 0.93 and hit / true > 0.93


def test_viterbi_and_fit_on_a_small_chain():
    rng = random.Random(2)
    pages = []
    for _ in range(60):
        labels, feats = [], []
        for _ in range(12):
            y = labels[-1] if labels and rng.random() < 0.8 else rng.randint(0, 1)
            labels.append(y)
            feats.append([0, 1 + (y if rng.random() < 0.8 else 1 - y)])
        pages.append((feats, [0] * 12, labels))
    chain = crf.fit(pages, 3, 1)
    for feats, kinds, _ in pages[:10]:
        best = max(range(2 ** 12), key=lambda m: sum(
            (m >> i & 1) * sum(chain.weights[f] for f in feats[i]) + (chain.steps[0, m >> i - 1 & 1, m >> i & 1] if i else 0)
            for i in range(12)))
        assert chain.best(feats, kinds) == [best >> i & 1 for i in range(12)]


def test_blocks():
    found = dom.blocks("<p>a<b>b</b> c<br>d<p>e<ul><li>f<li>g</ul><script>x='</p>'</script>&lt;h&gt;<!-- no -->i")
    assert [b.text for b in found] == ["ab c d", "e", "f", "g", "<h>i"]
    for page in ("<" * 100_000, "<a \"" * 30_000, "<!--" * 30_000, "<p>" * 30_000, "&amp" * 30_000):
        start = time.time()
        dom.blocks(page)
        assert time.time() - start < 10


def test_odd_rows(spark, tmp_path):
    schema = "page_id bigint, url string, html string, text string, n_chars string, n_blocks string"
    rows = [(1, None, None, "t", "n", "b"), (1, "u", "", "t", "n", "b"), (None, "u", PAGE, "t", "n", "b"),
            (2, "u", PAGE, "t", "n", "b"), (2, "u", PAGE, "t", "n", "b"), (3, "u", "<p>" + "word " * 100_000, "t", "n", "b")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/pages.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/pages.parquet")
    got = plain(QUERIES["op3_html_extraction"](spark, f"{tmp_path}/a"))
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] == 1} == {""}
    assert plain(QUERIES["op3_html_extraction"](spark, f"{tmp_path}/b")) == []


def test_depth_and_class_names_don_t_hide_containers(spark):
    """A page below hundreds of elements with many class words is extracted as the page itself."""
    chain = extraction.trained(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    inner = PAGE.split("<body>")[1]
    plain_text = extraction.main_text(PAGE, chain)[0]
    for depth in (10, 210, 3000):
        deep = "<html><body>" + "<div>" * depth + inner + "</div>" * depth
        assert extraction.main_text(deep, chain)[0] == plain_text, depth
    utility = " ".join(f"px-{w}" for w in ("flex", "grid", "gap", "mt", "mb", "round", "shadow", "font", "text", "bg", "hover", "focus", "lg", "md"))
    nested = lambda tag, word: (f'<{tag} class="{word} {utility}">' + f'<div class="{utility}">' * 3)
    found = dom.blocks(nested("div", "comments") + "<p>One <b><i><u><em><a href=x><span>linked words</span></a></em></u></i></b></p>")
    assert "comments" in found[0].tokens and found[0].linked == len("linked words") and "div" in found[0].tags


def test_scanner_is_linear_in_depth():
    for page in ("<div>" * 200_000 + "x", "<b>" * 100_000 + "<p>x" * 20_000, "<div><p>x</div>" * 50_000, "</div>" * 300_000,
                 "".join(f"<div class=c{'abcdefgh'[i % 8]}>" for i in range(100_000)) + "x"):
        began = time.process_time()
        dom.blocks(page)
        assert time.process_time() - began < 10
