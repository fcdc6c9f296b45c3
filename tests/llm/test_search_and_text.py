import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import ann, htmltext, licenses


def brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 100 == 0 and q not in out:
            d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, x) for x, i in d[:k]]
    return out


@pytest.mark.parametrize("blocks", [(4096, 16384), (3, 40)])
def test_nearest(spark, blocks):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((6, 24))
    rows = [(i, (centres[i % 6] + 0.4 * draw.standard_normal(24)).astype(np.float32).astype(float).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)] + [(2000, rows[100][1]), (2100, [1.0, 2.0]), (2101, [2.0, 2.0])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0] * 23 + [float("nan")]), (3100, [float("inf")] * 24), (None, [1.0] * 24), (3200, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("v", F.lit(1)).withColumn("label", F.lit(0))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10, *blocks).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 10)
    assert set(got) == set(want)
    hits = total = 0
    for q, w in want.items():
        assert [x[0] for x in got[q]] == list(range(1, len(w) + 1))
        hits += len({x[1] for x in got[q]} & {i for i, _ in w})
        total += len(w)
    assert hits / total >= 0.99
    assert hits == total  # recall 1.0
    assert [x[1] for x in got[2000]] == [100, *range(1000, 1009)] and got[2000][0][2] == 0.0
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_ids_are_candidates_each(spark):
    draw = np.random.default_rng(5)
    v = draw.standard_normal((40, 8)).tolist()
    rows = [(i, v[i]) for i in range(30)] + [(7, v[30]), (7, v[7]), (0, v[31]), (0, v[0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 40, 5, 3).orderBy("rank").collect()]
    q = min(v[0], v[31])
    want = sorted((float(np.sqrt(((np.array(w) - q) ** 2).sum())), i) for i, w in rows if i)
    assert [(r[0], r[1], r[2]) for r in got] == [(0, n, i) for n, (_, i) in enumerate(want, 1)] and [r[3] for r in got] == pytest.approx([d for d, _ in want])


def test_far_cells_are_not_visited(spark):
    """Of separate groups, a query visits its own cells only, and still finds its nearest exactly."""
    draw = np.random.default_rng(6)
    rows = [(i, (np.eye(16)[i % 8] * 50 + draw.standard_normal(16)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    centre = ann.centres(ann.usable(df), 50)[16]
    assert len(centre) == 16
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in w] for q, w in brute(rows, 10).items()}


def test_bounds_hold():
    draw = np.random.default_rng(1)
    x, q = draw.standard_normal((2000, 64)), draw.standard_normal((20, 64))
    centre, turn = x.mean(axis=0), ann.rotation(64)
    assert turn @ turn.T == pytest.approx(np.eye(64), abs=1e-9)
    estimate, low = ann.bounds(*ann.encode(x, centre, turn), q, centre, turn)
    exact = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    assert (low <= exact + 1e-6).mean() > 0.999 and abs((estimate - exact).mean()) < 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site for you</div>{open}<h2>Head  &amp; line</h2>
<p>First   paragraph of the <b>main</b> text,<br>with a&nbsp;break and some more words to read here.</p><div class="ad">Buy this now please</div>
<p>Second paragraph &lt;tag&gt; with <a href="x">a link</a> inside and still more words that make up the text.<p>Third unclosed paragraph of words
<form><input name=q><label>Search here</label></form>{close}<section id="comments"><p>Reader comment one says many words about nothing at all</p></section>
<aside class="sidebar"><p>Related words in the side</p></aside><footer>Copyright &copy; words</footer></body></html>"""
MAIN = "Head & line First paragraph of the main text, with a break and some more words to read here. Second paragraph <tag> with a link inside and still more words that make up the text. Third unclosed paragraph of words"


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("", "")])
def test_main_text(around):
    page = PAGE.replace("{open}", around[0]).replace("{close}", around[1])
    assert htmltext.extract(page) == MAIN


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "<nav><a>only menu</a></nav>"), (4, None, "plain words & more"), (5, "u", "<p>unclosed <b>tag < 5"), (6, "u", "<article>" + "<p>word word</p>" * 20_000), (4, None, "plain words & more"), (7, "u", "<!-- never closed <p>x"), (8, "u", "<script>x")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    weights = htmltext.learn(df)
    rows = htmltext.extracted(df, weights).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 9 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [got[i]["text"] for i in (1, 2, 3, 4, 7, 8)] == ["", "", "", "plain words & more", "", ""]
    assert got[6]["text"] == " ".join(["word word"] * 20_000) and got[5]["text"].startswith("unclosed tag")
    assert htmltext.extracted(df.limit(0), htmltext.learn(df.limit(0))).count() == 0


def test_best_region_is_the_best():
    draw = random.Random(0)
    for _ in range(200):
        x = [draw.randrange(-5, 6) for _ in range(draw.randrange(1, 12))]
        a, b = htmltext.best_region(np.array(x, float))
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


def test_licence_scan(docs):
    texts = [
        None, "", "no words of interest", "Released under the MIT License.", "mit-license MIT LICENSE mit licenses", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3. " * 3, "licensed under cc by-nc 4.0", "a licence of apache kind", "word " * 30_000 + "general public\nlicense",
        "All rights reserved. Copyright", "copyright (c) all rights reserved", "élicense MIT\x80license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    ]
    rows = [*enumerate(texts), (3, texts[3])]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert licenses.scan(docs(rows)).count() == len(rows)
    for i, t in enumerate(texts):
        n, places, labels = licenses.scan_one(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(labels)), i
        assert 0 <= r["score"] <= 1 and set(labels) <= set(r["labels"].split(","))
    assert got[5]["labels"] == "apache,apache-2.0" and got[6]["labels"] == "gpl,gpl-3.0" and got[7]["labels"] == "cc-by-nc-4.0" and got[8]["labels"] == ""
    assert got[3]["labels"] == "mit,mit-notice" and got[13]["labels"] == "mit-notice" and got[11]["labels"] == "all-rights-reserved" and got[10]["labels"] == "all-rights-reserved"
    assert licenses.scan(docs([])).count() == 0


def test_same_as_sql(spark):
    """The registered queries that SQL can express, on the smallest tables."""
    import os

    import duckdb

    from credence.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key), name


def test_licence_scan_of_several_notices(docs):
    """Files of more than twelve licence words keep every notice, however common its words are."""
    notices = {k: t for k, t, _ in licenses.TEMPLATES}
    first = {"mit-notice": "released under the mit license", "mit-text": licenses.TEMPLATES[1][1]}
    files = [
        (["bsd-notice", "isc-notice", "mit-notice"], [licenses.TEMPLATES[8][1], notices["isc-notice"], first["mit-notice"]]),
        (["apache-2.0", "bsd-notice", "mit-notice"], [first["mit-text"], licenses.TEMPLATES[8][1], notices["apache-2.0"]]),
        (["apache-2.0", "gpl-notice", "mit-notice", "mpl-2.0"], [first["mit-text"], notices["gpl-notice"], notices["apache-2.0"], notices["mpl-2.0"]]),
        (sorted(notices), [t for _, t, _ in licenses.TEMPLATES]),
    ]
    common = ["released under the mit license", "licensed under the apache license version 2 0", notices["mpl-2.0"]] * 20
    rows = list(enumerate([" filler words between ".join(parts) for _, parts in files] + common))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(rows)).collect()}
    for i, (labels, _) in enumerate(files):
        assert set(labels) <= set(got[i]), i


PROSE = "Some long running prose of the text with quite a few words that a reader would want to read here"


@pytest.mark.parametrize("wrapper", ["content-sidebar-wrap", "has-sidebar", "sidebar", "page header-fixed"])
def test_wrapper_names_leave_the_article(wrapper):
    page = f"<body><nav><a>Menu</a></nav><div class='{wrapper}'><article><p>{PROSE}</p></article></div><footer>Foot</footer></body>"
    assert htmltext.extract(page) == PROSE
    assert htmltext.extract(page.replace("article>", "main>")) == PROSE


def test_names_inside_an_article():
    page = "<body><article><header class='entry-header'><h1>The title</h1></header><p>{0}</p><section class='related-work'><h2>Related work</h2><p>{0}</p></section><figure><figcaption>Caption words</figcaption></figure><p>Let <math><mi>x</mi></math> be <object>an object</object></p><div class='share-buttons'><a>Tweet</a></div><div class='ad'>Buy</div></article><section id='comments'><article class='comment'><p>{0}</p></article></section></body>".format(PROSE)
    assert htmltext.extract(page) == f"The title {PROSE} Related work {PROSE} Caption words Let x be an object"


LONG = " ".join(f"{PROSE} and so on, part {i}." for i in range(6))


@pytest.mark.parametrize("part", ["<p title='the hidden gem'>{}</p>", "<div class='social-science'><p>{}</p></div>", "<div class='notice'><p>{}</p></div>", "<div class='article-header'><p>{}</p></div>", "<p class='ad-free'>{}</p>", "<p data-hidden='1'>{}</p>", "<figcaption>{}</figcaption>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_attributes_and_names_alone_delete_no_article(part, around):
    page = "<body><nav><a>Menu</a></nav>" + around.format(part.format(LONG)) + "<footer>Foot</footer></body>"
    assert htmltext.extract(page) == LONG


def test_what_is_named_goes_and_what_is_hidden_stays():
    inside = "<div class='notice'>We changed our terms</div><div id=comments>six</div>"
    kept = "<p hidden>one two three</p><p aria-hidden=true>four</p><p style='color:red; display : none'>five</p><div hidden='until-found'>six</div>"
    assert htmltext.extract(f"<article><p>{LONG}</p>{inside}{kept}<p>{PROSE}</p></article>") == f"{LONG} one two three four five six {PROSE}"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_ids_of_headings_and_names_of_text_say_nothing(around):
    parts = ['<h2 id="notice">Notice periods</h2>', '<h2 id="comments">Comments in code</h2>', '<p id="menu">Menu planning is hard</p>', '<ul><li id="related">Related fields</li></ul>', '<pre class="widget">make widget</pre>', "<table><tr><td class='footer'>Sum</td></tr></table>", '<section id="promo"><h2>Promo formats</h2></section>']
    page = "<body><nav><a>Menu</a></nav>" + around.format("".join(f"{x}<p>{PROSE}</p>" for x in parts)) + "<div id='sidebar'><p>Side words</p></div><footer>Foot</footer></body>"
    heads = ["Notice periods", "Comments in code", "Menu planning is hard", "Related fields", "make widget", "Sum", "Promo formats"]
    assert htmltext.extract(page) == " ".join(f"{h} {PROSE}" for h in heads)


def test_parts_far_apart():
    gap = "<div></div>" * 10
    assert htmltext.extract(f"<body><article><p>{PROSE}</p></article>{gap}<article><p>{LONG}</p></article>{gap}<article>ad</article></body>") == f"{PROSE} {LONG}"
    assert htmltext.extract(f"<body><nav>Menu</nav><div><div><div><h1>The <b>title</b></h1></div></div></div><div><p>{LONG}</p></div></body>") == f"The title {LONG}"
    assert htmltext.extract(f"<body><div><div><h1>Site</h1></div></div><div><div>Other words here</div></div><div><p>{LONG}</p></div></body>").endswith(LONG)
    weights = htmltext.weights_of({"word": (50, 900), "linked": (300, 20), "<li": (5000, 1), "<ul": (900, 1), "<p": (10, 90), "<div": (400, 10)})
    assert htmltext.extract(f"<body><div><p>{LONG}</p><ul>{'<li>A point of some words</li>' * 5}</ul><p>{LONG}</p></div></body>", weights) == f"{LONG} {' '.join(['A point of some words'] * 5)} {LONG}"


def test_links_between_paragraphs():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Some linked title {i}</a></li>" for i in range(20)) + "</ul>"
    assert htmltext.extract(f"<body><div><p>{LONG}</p>{menu}<p>{LONG}</p></div></body>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</p>" * 20_000, "<p a=\"'" * 40_000, "<p a=\"'" * 40_000 + ">", "<p x='>" * 30_001, "<" * 220_000, "<!" * 100_000, "</a" * 70_000, "<a b='" * 30_000 + ">" * 3000, "<ul><li><a>x" * 15_000, "<script>" * 25_000])
def test_adversarial_pages_are_linear(page):
    import time

    began = time.process_time()
    htmltext.extract(page)
    assert time.process_time() - began < 1.5


def test_against_a_brute_force_extractor():
    """On random pages: of all contiguous regions, the text of the one with the largest sum of scores, and of each further labelled
    part that reaches its share of that."""
    draw = random.Random(4)
    kinds = ["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<b>", "</b>", "<article>", "</article>", "<nav>", "</nav>", "<br>", "words of text ", "more words &amp; others here ", "<ul><li>", "</ul>", "<div class=ad>", "<td>", "<div><div>"]

    def text_of(tokens):
        made, block = [], ""
        for kind, name, aside, *_ in [*tokens, ("end", "div", False)]:
            if kind == "text":
                block += "" if aside else name
            elif name not in htmltext.INLINE:
                made.append(" ".join(block.replace("&amp;", "&").split()))
                block = ""
        return " ".join(x for x in made if x)

    def best(scores, low, high):
        """All ranges of the largest sum above 0."""
        sums = {(i, j): sum(scores[i:j]) for i in range(low, high) for j in range(i + 1, high + 1)}
        top = max(sums.values(), default=0)
        return [r for r, x in sums.items() if x >= top - 1e-9] if top > 1e-9 else [], top

    several = 0
    for _ in range(600):
        page = "".join(draw.choice(kinds) for _ in range(draw.randrange(1, 36)))
        tokens = htmltext.parsed(page)
        scores = htmltext.scored(tokens, htmltext.PLAIN)
        firsts, top = best(scores, 0, len(scores))
        texts = set() if firsts else {""}
        for i, j in firsts:
            words = [(len(t[1].split()), t[3] in ("article", "main")) for t in tokens[i:j] if t[0] == "text" and not t[2]]
            parts = [[(i, j)]]
            if 2 * sum(n for n, own in words if own) >= sum(n for n, _ in words):
                k = 0
                while k < len(tokens):
                    end = k
                    while end < len(tokens) and tokens[end][3] in ("article", "main") and not i <= end < j:
                        end += 1
                    found, more = best(scores, k, end)
                    if found and more >= htmltext.FURTHER * top - 1e-9:
                        parts.append(found)
                    k = max(end, k + 1)
            several += len(parts) > 1
            for chosen in itertools.product(*parts):
                texts.add(" ".join(x for x in (text_of(tokens[a:b]) for a, b in sorted(chosen)) if x))
        assert htmltext.extract(page) in texts, page
    assert several


def test_components_beyond_what_squares_hold(spark):
    import math

    draw = np.random.default_rng(8)
    rows = [(i, (draw.standard_normal(5) * (1e200 if i % 3 == 0 else 1)).tolist()) for i in range(260)] + [(300, [1.7e308, -1.7e308, 0.0, 0.0, 1.0]), (301, [1.7e308, -1.6e308, 0.0, 0.0, 1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0, 10, 40, 30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    distance = lambda v, w: 4 * math.hypot(*[a / 4 - b / 4 for a, b in zip(v, w, strict=True)])
    for q in (0, 100, 200, 300):
        v = dict(rows)[q]
        want = sorted((distance(v, w), i) for i, w in rows if i != q)[:10]
        assert [r["score"] for r in got[q]] == pytest.approx([d for d, _ in want], rel=1e-12)
        assert {r["vec_id"] for r in got[q]} == {i for _, i in want} or len({d for d, _ in want}) < 10


def test_centres_are_fitted_on_bounded_bytes(spark, monkeypatch):
    """At 768 components, the sample has the bytes that it may have, whatever the number of cells asked for."""
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 1 << 20)
    df = spark.range(1500).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: F.hash("id", i).cast("float")).alias("embedding"))
    centre = ann.centres(ann.usable(df), 10)[768]
    assert centre.shape == ((1 << 20) // (8 * 768) // ann.LEAST_PER_CELL, 768)


def test_whole_licence_texts(docs):
    """Public licence texts, where the system has them, get their labels; and a notice is found whatever words the files make common."""
    import os

    at = "/usr/share/common-licenses"
    wanted = {"Apache-2.0": "apache-2.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0", "LGPL-3": "lgpl-3.0", "LGPL-2.1": "lgpl-2.1", "MPL-2.0": "mpl-2.0", "MPL-1.1": "mpl-1.1", "BSD": "bsd-notice", "GFDL-1.3": "gfdl-notice", "CC0-1.0": "cc0-1.0"}
    there = [x for x in wanted if os.path.exists(f"{at}/{x}")]
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(i, open(f"{at}/{x}", errors="replace").read()) for i, x in enumerate(there)] + [(50, isc), (51, mit), (52, "in no event will the authors be held liable for any damages arising from the use of this software"), (53, "Eclipse Public License - v 2.0")]
    rows += [(100 + i, "license apache version public general gnu software permission mozilla any damages copies notice the of") for i in range(40)]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(rows)).collect()}
    for i, x in enumerate(there):
        assert wanted[x] in got[i], (x, got[i])
    assert "isc-notice" in got[50] and "mit-notice" in got[51] and "zlib" in got[52] and "epl-2.0" in got[53] and got[120] == [""]


def test_chosen_words_are_the_rarest_of_each_phrase():
    postings, least = licenses.index({"license": 90, "mit": 2, "under": 80, "the": 100})
    first = [(w, i) for k, w, i in postings if k == 0]
    assert first == [("license", 4), ("mit", 3)] and least[0] == 2
    k = next(k for k, t in enumerate(licenses.TEMPLATES) if t[0] == "gpl-3.0")
    words = {w for t, w, _ in licenses.index({"general": 9, "public": 8, "license": 7, "version": 6, "3": 5})[0] if t == k}
    assert words == {"version", "3"}
