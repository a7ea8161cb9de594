"""Main text of pages on fixtures, and ranked search against plain counting."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mesograph.llm import html_text, search

WORDS = frozenset(" ".join(html_text.STOP_WORDS.values()).split())
LONG = "The cells in the image were counted by hand and the results of the count are shown in the table that follows, which is the work of two weeks. " * 2
MORE = "It was found that the size of the particles is not what we had expected from the theory, and that their shape is a matter of the temperature. " * 2


def main(page):
    return html_text.main_text(page, WORDS)


def clean(*parts):
    return " ".join(" ".join(p.split()) for p in parts)


CASES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Short</h1><p>{LONG}<p>One.</p><p>{MORE}</article><footer>&copy; x</footer>",
                clean("Short", LONG, "One.", MORE)),
    "no article element": (f"<body><header>Site of the lab</header><div id=menu><ul><li><a href=a>The one</a><li><a href=b>The two</a></ul></div><div><h2>Title</h2><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></div>"
                           f"<div class='side-bar sidebar'><p>{LONG}</p></div><div class=cookie-notice>{MORE}</div><p><a href=1>the links</a> <a href=2>of all the pages</a> that we have", clean("Title", LONG, "Yes.", MORE)),
    "comments": (f"<main><p>{LONG}</p><section id='comments'><article><p>{MORE}</p></article></section></main>", clean(LONG)),
    "advert and form in the article": (f"<article><p>{LONG}</p><div class='ad'>{MORE}</div><form><p>{MORE}</p></form><aside>{MORE}</aside><p>{MORE}</p></article>", clean(LONG, MORE)),
    "hidden and roles": (f"<div role=navigation>{MORE}</div><div hidden>{MORE}</div><div style='color:red; display: none'>{MORE}</div><p>{LONG}</p>", clean(LONG)),
    "characters": (f"<article><p>a&amp;b &lt;c&gt; &#233;&#x20AC;&nbsp; x\n\t y&eacute{LONG}</p></article>", clean("a&b <c> é€ x yé" + LONG)),
    "markup that never closes": (f"<article><p title='a>b' class=x>{LONG}<b>bold <i>{MORE}<script>var x = '</p>'; track(1)</script><!-- {MORE} -->", clean(LONG + "bold " + MORE)),
    "unclosed comment": (f"<p>{LONG}</p><!-- {MORE}", clean(LONG)),
    "unclosed menu": (f"<nav><ul><li><a>x</a><article><p>{LONG}</p></article>", clean(LONG)),
    "tiny article": ("<nav>a b c</nav><div class=ad>The ad of the day</div><article><h1>Be.</h1></article><footer>f</footer>", "Be."),
    "only short text": ("<div><p>Just this.</p></div>", "Just this."),
    "class that looks like an aside": (f"<div class='has-sidebar content'><p>{LONG}</p></div>", clean(LONG)),
    "all inside a hinted element": (f"<div class=menu><p>{LONG}</p></div>", clean(LONG)),
    "empty": ("", ""), "none": (None, ""), "markup only": ("<html><body><script>x</script></body></html>", ""), "text only": ("Just a text", "Just a text"),
    "other script": ("<article><p>" + "顕微鏡の画像を数える。" * 30 + "</p><p>短い。</p></article>", "顕微鏡の画像を数える。" * 30 + " 短い。"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, want = CASES[name]
    assert main(page) == want


def test_link_lists_and_notices_outside_an_article_are_bad():
    links = " ".join(f"<a href={i}>the story of the day {i}</a>" for i in range(30))
    assert main(f"<p>{LONG}</p><div>{links}</div><p>{MORE}</p><p>© The company of the lab, all rights of the owner are reserved by it.</p>") == clean(LONG, MORE)


def test_long_broken_pages_are_read_in_time():
    for piece in ("<p", '<a href="', "<!--", "<div>", "&amp", "<", "</b>", "<p class='"):
        main(piece * 100_000)


def test_extract_text_keeps_columns_and_rows(spark):
    rows = [(1, p, "old", 5, "x") for p, _ in CASES.values()] + [(2, "<p>Just this.", None, 0, "y")] * 2
    table = spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int, _extracted string")
    out = html_text.extract_text(table)
    got = out.collect()
    assert sorted((r.text, r.n_chars, r._extracted) for r in got) == sorted([(w, len(w), "x") for _, w in CASES.values()] + [("Just this.", 10, "y")] * 2)
    assert html_text.extract_text(table.limit(0)).count() == 0


# --- search

def plain_search(texts, items, most=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(i, find((t or "").translate(lower))) for i, t in texts]
    with_terms = [d for d in docs if d[1]]
    n_docs, total = len(with_terms), sum(len(w) for _, w in with_terms)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(find((text or "").translate(lower)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for ident, words in with_terms:
            m, score = 100 - 90 + (90 * len(words) * n_docs) // total, 0
            for term in terms:
                df, tf = sum(term in w for _, w in with_terms), words.count(term)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, ident is None, ident or 0, ident))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("together", [200_000, 7])
def test_search_equals_plain_counting(spark, together):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["über", "Ärger", "a", "A", "x2", "漢字"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ". ", "_", "\n"]) for _ in range(n))
    texts = [(i, make(rng.randint(1, 40))) for i in range(80)] + [(100 + i, t) for i, t in enumerate([None, "", " -_- ", "w1", "W1", "w1 " * 3000, "zzz", "w1w1"])] + [(5, "w3 w4"), (5, "w3 w4"), (None, "w3 w5")]
    items = [(f"q{i}", make(n)) for i, n in enumerate((3, 1, 25, 6))] + [("none", None), ("blank", "..."), ("far", "nowhere"), ("q0", "w7 w8"), (None, "w9 w3"), ("twin", "w1"), ("tie", "w3")]
    rng.shuffle(texts)
    notes = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in texts], "ann_id long, label string, score int, item_id string, rank int").repartition(5)
    queries = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id string, text string, ann_id int")
    got = [(r.item_id, r["rank"], r.ann_id, r.score) for r in search.search_labels(notes, queries, terms_together=together).collect()]
    assert sorted(got, key=str) == plain_search(texts, items)


def test_search_without_items_or_texts(spark):
    notes = spark.createDataFrame([(1, "a b")], "ann_id int, label string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert search.search_labels(notes, items.limit(0)).columns == ["item_id", "rank", "ann_id", "score"] and search.search_labels(notes, items.limit(0)).count() == 0
    assert search.search_labels(notes.limit(0), items).count() == 0
    assert [tuple(r)[:3] for r in search.search_labels(notes, items).collect()] == [("q", 1, 1)]
    assert search.search_labels(notes.withColumn("label", F.lit(None).cast("string")), items).count() == 0
