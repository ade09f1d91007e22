"""Rows, words and page parts that operators must not lose."""

import random
import time
import xml.etree.ElementTree as ET
from collections import defaultdict

import numpy as np

from assaygrid.llm import html_main, topk, toxicity


# Search


def exact(data, k=10):
    good = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 100 == 0:
            s = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i)[:k]
            out |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s)}
    return out


def search(spark, data, k=10):
    rows = topk.search_table(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2), "vec_id % 100 = 0", k).collect()
    assert len(rows) == len({(r.query_id, r["rank"]) for r in rows})
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows}


def test_wide_vectors_are_rows_like_others(spark):
    data = [(0, [1.0, 2.0]), (1, [20000.0, 1.0]), (2, [0.5, 0.5]), (100, [-30000.0, 0.0])]
    assert search(spark, data) == exact(data) and len(exact(data)) == 6


def test_wide_and_narrow_vectors_together(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    rng = np.random.default_rng(5)
    scale = 10.0 ** rng.integers(-2, 6, 400)
    data = [(i, (rng.normal(size=6) * scale[i]).tolist()) for i in range(400)]
    data += [(500, [1e300] + [0.0] * 5), (501, [-1e300, 1.0] + [0.0] * 4), (600, [float("inf")] + [0.0] * 5), (700, [None] * 6)]
    # Scores that fit a long are exact; what goes beyond is saturated and still ranks.
    got = search(spark, data)
    assert {g[0] for g in got} == {0, 100, 200, 300, 500} and all(len([g for g in got if g[0] == q]) == 10 for q in (0, 100, 200, 300, 500))
    assert search(spark, data[:400]) == exact(data[:400])


# Toxicity


def test_short_words_and_swaps():
    lexicon = toxicity.Lexicon(dict.fromkeys("scum idiot stupid worthless".split(), 1.0), {})
    for word, term in {"scvm": "scum", "scumm": "scum", "idoit": "idiot", "stpuid": "stupid", "wortlhess": "worthless", "sucm": "scum"}.items():
        assert lexicon.look(word)[1] == term
    assert lexicon.look("scum") == (1.0, None) and lexicon.look("skum!") == (0.5, "scum")
    assert lexicon.look("sum")[1] == "scum"
    for word in ("scrums", "", "...", "idol"):
        assert lexicon.look(word) is None


def test_long_words_and_repeated_labels(spark):
    bad, rnd = "vile" + "x" * 60, random.Random(2)
    docs = [(i, " ".join(rnd.choice("abcdefgh") * 4 for _ in range(20)) + (f" {bad}" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = toxicity.score(frame, spark.createDataFrame(labels + labels[:40], "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.predicted for r in found} == dict(labels)


# Main text


def wanted(html):
    return [t for t, _, part in html_main.parse(html)[0] if not part]


LONG = "The old mill by the river turned its wheel all day while the miller slept on. " * 4


def test_titles_forms_and_compound_names():
    assert wanted("<article><header><h1>Title</h1><span>By me</span></header><p>text</p></article>") == ["Title", "text"]
    assert wanted("<header><h1>Site</h1></header><article><header class=ad><h2>Buy</h2></header><p>text</p></article>") == ["text"]
    story = LONG.strip()
    for part in ("<form id=aspnet><div id=story>%s</div><input><label>Name</label></form>", "<div class=social-history>%s</div>", "<div class=promotion>%s</div>",
                 "<section id=search>%s</section>"):
        assert wanted("<body>" + part % f"<p>{LONG}</p>" + "</body>") == [story]
        assert wanted("<body>" + part % "<p>Find it</p>" + "</body>") == []
    for part in ("<div class=comments>%s</div>", "<nav>%s</nav>", "<div class='cookie-consent'>%s</div>", "<div class='ad social'>%s</div>", "<div hidden>%s</div>"):
        assert wanted("<body>" + part % f"<p>{LONG}</p>" + "</body>") == []
    # A form inside an unwanted part stays unwanted, however long.
    assert wanted(f"<aside><form><p>{LONG}</p></form></aside>") == []


def test_deep_pages_take_linear_time():
    n = 20_000
    for html in ("<div>" * n + "x" + "</div>" * n, "<div>w " * n, "<div>w " * n + "</section></b>" * n, "<p>" * n + "</div>" * n, "<div><p>w</div>" * n):
        begin = time.process_time()
        blocks, tree, _ = html_main.parse(html)
        html_main.without_templates(blocks, [t[1] for t in tree], [t[0] for t in tree], {tree[0][0]})
        assert time.process_time() - begin < 5 and len(tree) >= n


def naive(pages, least, share, full, light):
    """Texts by page, subtrees compared as whole strings and counted host by host."""
    trees = [(i, host, ET.fromstring(html)) for i, host, html in pages]
    canon = lambda e: ET.tostring(e, encoding="unicode").strip()
    blocks = lambda e: [" ".join(x.split()) for x in e.itertext() if x.split()]
    words = lambda e: sum(len(b.split()) for b in blocks(e))
    whole, seen, kind = defaultdict(set), defaultdict(set), {}
    for _, host, root in trees:
        page = "\n".join(blocks(root))
        whole[host].add(page)
        for e in root.iter():
            if e.tag != "body":
                seen[host, canon(e)].add(page)
                kind[canon(e)] = 0 if e.tag == "p" else 2 if words(e) < html_main.MANY else 1
    bounds = [(least, share), (min(least, full[0]), min(share, full[1])), (min(least, light[0]), min(share, light[1]))]
    gone = {(h, c) for (h, c), p in seen.items() if len(p) >= bounds[kind[c]][0] and len(p) >= bounds[kind[c]][1] * len(whole[h])}

    def left(host, e):
        if e.tag != "body" and (host, canon(e)) in gone:
            return []
        out = [" ".join(e.text.split())] if (e.text or "").split() else []
        for c in e:
            out += left(host, c)
        return out

    return {i: "\n\n".join(left(host, root)) for i, host, root in trees}


def test_templates_against_a_naive_counter(spark):
    rnd = random.Random(9)
    menu = [f"<div><div>menu {k}</div><div>team {k}</div></div>" for k in range(6)]
    story = [f"<section><p>{LONG} {k}</p><p>more {k}</p></section>" for k in range(4)]

    def part(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice([f"<p>note {rnd.randrange(30)}</p>", f"<div>line {rnd.randrange(60)}</div>", rnd.choice(menu), rnd.choice(story)])
        return "<div>" + "".join(part(depth - 1) for _ in range(rnd.randint(1, 3))) + "</div>"

    pages = [(i, f"h{i % 4}", "<body>" + "".join(part(3) for _ in range(rnd.randint(1, 4))) + f"<p>only {rnd.randrange(70)}</p></body>") for i in range(160)]
    rows = [(i, f"http://{host}/{i}", html) for i, host, html in pages]
    options = dict(least=6, share=0.3, full=(8, 0.1), light=(3, 0.05))
    got = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), **options).collect()
    want = naive(pages, **options)
    assert {r.page_id: r.text for r in got} == want and sum(r.n_removed for r in got) > 50
