from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vigilark.llm import additive, cross_parsing, html_blocks, registry

FOLDER = "/root/testdata/sf0.01"


def greedy(text, sample):
    """Phrases by plain search for the longest known string."""
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


def test_phrases_are_those_of_a_plain_search():
    rng = random.Random(1)
    make = lambda n, k: bytes(rng.choice(b"abcd "[:k]) for _ in range(n))
    samples = {"x": make(300, 3), "y": make(200, 5)}
    parser = cross_parsing.Parser(samples)
    texts = [make(n, 5) for n in (1, 2, 50, 300, cross_parsing.SEGMENT)] + [b"zz a"]
    got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    assert got.tolist() == [[greedy(t, samples[l]) for t in texts] for l in ("x", "y")]


def test_long_texts_are_parsed_whole():
    rng = random.Random(2)
    make = lambda n, k: bytes(rng.choice(b"abcd "[:k]) for _ in range(n))
    samples = {"x": make(11_000, 3), "y": make(400, 5) + b"ababa"}
    parser = cross_parsing.Parser(samples)
    texts = [samples["x"][500:10_500], make(10_000, 3), make(6_000, 5), b"ab" * 2_500, b"z" * 2_000, samples["x"][:3_000] + b"z" + samples["x"][:3_000], b"a"]
    got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    assert got.tolist() == [[greedy(t, samples[l]) for t in texts] for l in ("x", "y")]
    assert got[0, 0] == 1


def test_copies_do_not_fill_a_language(spark):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60))
    one = make("klm")
    rows = [(i, one, "p") for i in range(300)] + [(1000 + i, make("abc"), "p") for i in range(20)] + [(2000 + i, make("xyzabc"), "q") for i in range(20)]
    df = spark.createDataFrame(rows + [(3000 + i, make("abc"), None) for i in range(5)], "doc_id long, text string, lang string")
    got = cross_parsing.languages(df, F.col("doc_id") >= 3000).where("held_out").collect()
    assert {r["lang_pred"] for r in got} == {"p"} and len(got) == 5


def test_normalised_rows():
    raw = pa.array(["  Ab, c!", "", None, "ÉTÉ 12 ß", " . "])
    flat, ends = cross_parsing.normalised(*cross_parsing.text_buffer(raw))
    assert [flat[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [" ab c ", " ", " ", " été ß", " "]


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = registry.QUERIES["op5_cross_parsing"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1
    odd = spark.createDataFrame([(1, None, "en", False), (2, "12 .", "en", False), (2, "—…", None, True), (None, "the and of", "en", False), (5, "der die und", "de", False), (6, "x" * 200_000, None, True)], "doc_id long, text string, lang string, held boolean")
    found = [(r["doc_id"], r["lang_pred"]) for r in cross_parsing.languages(odd, F.col("held")).collect()]
    assert sorted(found[:3] + found[4:5], key=str) == [(1, "und"), (2, "und"), (2, "und"), (5, "de")] and len(found) == 6
    assert cross_parsing.languages(odd.limit(0), F.col("held")).collect() == []
    assert {r["lang_pred"] for r in cross_parsing.languages(odd.withColumn("lang", F.lit(None).cast("string")), F.col("held")).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make all of this work for you and for us.</div>
<article><h1>A &amp; B</h1><p><b>First</b> para&shy;graph\n with <a href="x>y">a link</a>.<br>Next<p>Second &lt;b&gt; &#8364;5
<div class="ad">Buy now and save a lot of money on things.</div><p>Short.</p><form><p>Your mail <input name=q></form><!-- <p>no</p> -->
<section class="comments"><p>I liked this very much indeed, thank you all.</p></section></article>
<aside><p>Other stories that you may like to read on this site today.</p></aside><footer>&copy; Site</footer>"""


def test_main_text_of_pages(spark):
    want = "A & B\nFirst para\xadgraph with a link. Next\nSecond <b> €5\nShort."
    rows = [(1, "u", PAGE, "x", 3), (2, None, None, "x", 3), (3, "u", "", "x", 3), (None, "u", "<nav><a>x</a></nav>", "", 1), (1, "u", PAGE, "x", 3), (5, "u", "<p>" + "word " * 30000, "", 1), (6, "u", "a < b <", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_blocks.main_texts(pages).collect()), key=str)
    long = ("word " * 30000).strip()
    assert got == sorted([(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (None, "", 0), (5, long, len(long)), (6, "", 0)], key=str)
    assert html_blocks.main_texts(pages.limit(0)).collect() == []


def test_given_pages_are_their_articles(spark):
    import html
    import re

    for r in registry.QUERIES["op6_main_text"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", p).replace("<br>", " "))).strip() for p in re.split(r"</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = registry.QUERIES["op7_additive_quality"](spark, FOLDER).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    ones, zeros = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.95


def test_quality_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "\n\n"), (None, "a b"), (4, "x " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    got = additive.quality_scores(odd, labels, F.lit(False)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = additive.quality_scores(odd, labels.limit(0), F.lit(False)).collect()
    assert all(abs(r["score"] - 0.5) < 1e-9 and r["predicted"] == 0 for r in none)
    assert additive.quality_scores(odd.limit(0), labels, F.lit(False)).collect() == []


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = additive.AdditiveModel(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9 and (0, 1) in model.pairs


def test_articles_are_not_lost_to_markup_around_them(spark):
    words = " ".join(["plain words that make up a story"] * 8) + "."
    story, menu = f"<p>{words}</p><p>{words}</p>", "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
    side, said = "<aside><p>Other things to buy today and here.</p></aside>", f"<div class='comments'><article class='comment'><p>{words} I say.</p></article></div>"
    pages = {
        1: f"<html><head><title>T</title></head><body class='single has-sidebar'>{menu}<article>{story}</article>{side}</body></html>",
        2: f"<body>{menu}<div class='layout with-sidebar'><article>{story}</article>{side}</div></body>",
        3: f"<html><head><title>T</title><meta x><script>var a = '<div>';</script><body>{menu}<article>{story}</article></body></html>",
        4: f"<body>{menu}<noscript><article>{story}</article></body>",
        5: f"<body>{menu}<aside>Small note.<article>{story}</article></body>",
        6: f"<body class='sidebar'><div id='page-sidebar-layout'>{menu}<main class='sidebar'>{story}</main>{side}</div></body>",
        7: f"<body>{menu}<article>{story}</article>{said}</body>",
    }
    df = spark.createDataFrame([(k, "u", p) for k, p in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_blocks.main_texts(df).collect()}
    for k in pages:
        assert got[k].replace("Small note.\n", "") == f"{words}\n{words}", (k, got[k])
