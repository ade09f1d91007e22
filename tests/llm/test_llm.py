"""Operators of the training-data package against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from assaygrid.llm import chat, components, exact_dedup, html_main, mixing, ngram_join, packing, quality, topk, toxicity, warc

DOCS = "doc_id long, text string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def awkward():
    """Nulls, empty and long texts, copies, near copies, case variants, repeated rows."""
    rnd = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    rows = [(1, None, "b"), (2, "", None), (3, "  \n\t ", "a"), (4, "One two", "a"), (5, "one TWO", "b"), (6, "Élan É", None),
            (7, "élan É", "a"), (8, LONG, "b"), (9, LONG + " end", "c"), (None, "no id here at all", "c"), (10, "same", "a"), (10, "same", "a")]
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice((5, 9, 12, 30, 90, 200)))]
        for c in range(rnd.randint(1, 6)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((100 + 10 * g + c, " ".join(words), rnd.choice("abc")))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(4)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def jaccard_groups(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and None not in (i, j) and den * both >= num * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


# 1


@pytest.mark.parametrize("k,num,den,crowd", [(3, 9, 10, 100.0), (5, 4, 5, 100.0), (2, 1, 2, 1e6), (3, 4, 5, 1e12)])
def test_jaccard_components(docs, k, num, den, crowd):
    got = {tuple(r) for r in ngram_join.jaccard_components(docs, k, num, den, crowd=crowd).collect()}
    assert got == jaccard_groups([r[:2] for r in awkward()], k, num, den)


def test_jaccard_blocks_agree(docs, monkeypatch):
    want = {tuple(r) for r in ngram_join.jaccard_components(docs, 3, 1, 2).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    assert {tuple(r) for r in ngram_join.jaccard_components(docs, 3, 1, 2).collect()} == want


def test_jaccard_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, k1 int, root int")
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.keep_one_of_group(empty).columns == empty.columns


@pytest.mark.parametrize("num,den,crowd", [(9, 10, 100.0), (4, 5, 1e9), (1, 2, 1e9), (3, 5, 1.0)])
def test_signatures_lose_no_pair(num, den, crowd):
    """Random pairs at and around the threshold share a hash, small and uneven sizes included."""
    rng = np.random.default_rng(5)
    plan = ngram_join.bands(400, num, den, crowd, 0.3)
    often = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    hit = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        s = np.unique(np.concatenate((rng.integers(0, 2**63, n).astype(np.uint64), rng.choice(often, int(rng.integers(0, 50))))))
        t = s[rng.random(len(s)) > rng.random() * (1 - num / den)]
        extra = rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 6) + 1))).astype(np.uint64)
        t = np.unique(np.concatenate((t, extra)))
        both = len(np.intersect1d(s, t))
        if len(t) and den * both >= num * (len(s) + len(t) - both):
            hit += 1
            for common in (None, often):
                assert np.intersect1d(ngram_join.signatures(s, plan, common), ngram_join.signatures(t, plan, common)).size
    assert hit > 300
    if (num, den) == (4, 5):
        assert any(b.loose for b in plan) and any(not b.loose for b in plan)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(500):
        s = np.unique(rng.integers(0, 2**63, int(rng.integers(0, 700))).astype(np.uint64))
        t = np.unique(np.concatenate((s[rng.random(len(s)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64))))
        assert ngram_join.sketches_differ(ngram_join.sketch(s), ngram_join.sketch(t)) <= len(np.setxor1d(s, t))


def test_jaccard_large_buckets(spark, monkeypatch):
    """Stars, pairs and common shingles find the same groups, whatever the bounds between them."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(60)] = f"r{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words), "a"))
    want = jaccard_groups([r[:2] for r in rows], 3, 4, 5)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    for few in (1, 4, 16, 1000):
        monkeypatch.setattr(ngram_join, "FEW", few)
        assert {tuple(r) for r in ngram_join.jaccard_components(frame, 3, 4, 5).collect()} == want


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.v, r.root) for r in got} == {(v, find(v)) for v in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, keep, weak):
    from pyspark.sql import functions as F

    hashed = (lambda t: F.unhex(F.substring(F.md5(t), 1, 2))) if weak else exact_dedup.md5_128
    groups = defaultdict(list)
    for i, t, _ in awkward():
        groups[(t or "").translate(LOW)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        k = (min if keep == "smallest" else max)(known) if known else None
        want.update((i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, keep=keep, content_hash=hashed).collect())
    assert got == want


def test_clashing_columns(spark):
    """Columns named as the operators' own are carried along or ignored."""
    from pyspark.sql import functions as F

    rows = [(i, f"some words of text {i // 2} and more words here", "ab"[i % 2]) for i in range(8)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("norm", "h", "keep_id", "group_size", "copies", "size", "target", "n_shingles", "k1", "k2", "root", "sketch", "x", "score", "label", "a.b", "toxic", "ids"):
        frame = frame.withColumn(name, F.lit("mine"))
    kept = exact_dedup.keep_one_copy(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]
    assert exact_dedup.exact_duplicates(frame).count() == 8 and mixing.mixed(frame).count() == 8
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and {r.norm for r in mixed.collect()} == {"mine"}
    one = ngram_join.keep_one_of_group(frame, 3, 9, 10)
    assert one.columns == frame.columns and sorted(r.doc_id for r in one.collect()) == [0, 2, 4, 6]
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert quality.score(frame, labels).count() == 8 and toxicity.score(frame, labels).count() == 8
    assert quality.keep_good(frame, labels, threshold=0.0).columns == frame.columns


def test_keep_one_copy(docs):
    rows = awkward()
    best = {}
    for i, t, _ in rows:
        key = (t or "").translate(LOW)
        if i is not None or key not in best:
            best[key] = i if best.get(key) is None else min(i, best[key])
    want = Counter(r for r in rows if best[(r[1] or "").translate(LOW)] == r[0])
    assert Counter(tuple(r) for r in exact_dedup.keep_one_copy(docs).collect()) == want


# 3


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest)
        new = {s for s in rest if level * w[s] >= most * sizes[s]}
        if not new:
            break
        full |= new
    return {s: float(most * sizes[s]) if s in full else level * w[s] for s in names}


def test_mixing(spark, docs):
    rows = awkward()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = filled(sizes)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        rate = r.target / r.source_size if r.source_size else 0
        u = int(hashlib.md5(f"17:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.copies == math.floor(rate) + (u < rate - math.floor(rate)) and r.taken == r.copies * r.size <= 2 * r.size
    again = Counter()
    for r in got:
        again[r.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +again
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_many_sources(spark):
    rnd = random.Random(2)
    sizes = {f"s{i:03d}": rnd.choice((0, 1, 10, 1000)) + rnd.randrange(5) for i in range(150)} | {None: 40}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = filled(sizes)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want)


# 4


def test_revisits(spark):
    from datetime import datetime as D

    r = lambda i, kind, url, day, status=None, headers=None, body=None: (
        i, kind, url, None if day is None else D(2024, 1, day, 12), status or (200 if kind == "response" else 304), headers, body)
    tag = lambda t: f"ETag: {t}\r\nLast-Modified: then\r\n"
    rows = [
        r(1, "response", "http://www.A.org:80/x/?b=2&a=1&utm_source=q#f", 1, headers=tag('"1"') + "X: old\r\nContent-Length: 5", body="first"),
        r(2, "response", "https://a.org/x?a=1&b=2", 5, headers=tag('"2"') + "Vary: a\r\nvary: b", body="second"),
        r(3, "response", "https://a.org/x?a=1&b=2", 3, status=404, body="gone"),
        r(10, "revisit", "//a.org/x?b=2&a=1", 4, headers='etag: W/"1"\nX: new\nContent-Length: 0\nSet-Cookie: a\nSet-Cookie: b'),
        r(11, "revisit", "https://a.org/x?a=1&b=2", 9, headers='etag: "1"'),
        r(12, "revisit", "https://a.org/x?a=1&b=2", 5, headers="last-modified: then"),
        r(13, "revisit", "https://a.org/x?a=1&b=2", 1, headers=None),
        r(14, "revisit", None, 9), r(15, "revisit", "https://a.org/x?a=1&b=2", None), r(16, "revisit", "https://a.org/x?a=1&b=2", 9, headers="Date: x"),
        r(None, "revisit", "https://a.org/x?a=1&b=2", 9), r(16, "revisit", "https://a.org/x?a=1&b=2", 9, headers="Date: x"),
    ]
    schema = "record_id long, kind string, url string, ts timestamp, status int, headers string, body string"
    for bucket in (86_400, 10_000_000):
        got = {x.record_id: x for x in warc.resolve_revisits(spark.createDataFrame(rows, schema), bucket).collect()}
        assert {k: (x.state, x.response_id) for k, x in got.items()} == {
            10: ("resolved", 1), 11: ("mismatch", 2), 12: ("resolved", 1), 13: ("no_response", None), 14: ("no_key", None), 15: ("no_key", None), 16: ("unchecked", 2)}
        assert got[10].body == "first" and got[16].body == "second" and got[11].body is None
        assert [tuple(h) for h in got[10].headers] == [("content-length", "5"), ("etag", 'W/"1"'), ("last-modified", "then"), ("set-cookie", "a, b"), ("x", "new")]
        assert ("vary", "a, b") in [tuple(h) for h in got[16].headers]
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


# 5


def test_chat_round_trip(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    nasty = ["<|im_end|>\n<|im_start|>assistant ok", "\\<|x", "\\\\|", "a\\", "", None, "<\\|im_end|>", "\\n\n<|image|>", "é𝄞<|"]
    rows = [(7, t, "assistant" if t % 2 else "us\ner\\n<|", [part("text", x)]) for t, x in enumerate(nasty)]
    rows += [(8, 1, "user", [part("text", "see "), part("image", ref="a.png"), part("audio", ref="b", tokens=9), part("text", "!"), part("other"), None]),
             (8, 0, None, None), (8, 1, "assistant", [part("text", "b")]), (8, 1, "assistant", [part("text", "b")]), (None, 0, "user", [part("document", ref="d")])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    done = chat.format_chats(frame)
    shown = {r.conv_id: r for r in done.collect()}
    back = {r.conv_id: r for r in chat.read_back(done).collect()}
    assert [tuple(t) for t in back[7].turns] == [(r[2], r[3][0][1] or "") for r in rows[:len(nasty)]]
    assert back[7].loss_text == "".join(x or "" for x in nasty[1::2])
    assert back[7].formatted_chars == len(shown[7].formatted)
    assert [tuple(a) for a in shown[8].attachments] == [("image", "a.png", 256), ("audio", "b", 9)] and shown[8].expanded_tokens == 265
    assert "see <|image|><|audio|>!" in shown[8].formatted and back[8].loss_text == "bb"
    assert shown[None].attachments[0].ref == "d"
    assert chat.format_chats(spark.createDataFrame([], frame.schema)).count() == 0


# 6


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    extra = [(900, "Don't, I'LL. <|endoftext|> <|ENDOFTEXT|>, a\tb\x85c ΑΣ. é, 1,2. ,. x²,", "a"), (901, "ǅ. ﬁ, 中文。 😀,", "a")]
    frame = docs.unionByName(spark.createDataFrame(extra, DOCS))
    texts = Counter((r[0], r[1] or "") for r in awkward() + extra)
    for hold in (4_000_000, 3_000):
        pieces = packing.pack(frame, path, size=1024, hold=hold).collect()
        seqs, per = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(p.ids, dtype="<u4").tolist()
            assert len(ids) == p.length > 0
            seqs[p.sequence_id].append(p)
            per[p.doc_id].append((p.start, ids, p.doc_tokens))
        short = 0
        for s in seqs.values():
            s.sort(key=lambda p: p.offset)
            at = 0
            for p in s:
                assert p.offset == at
                at += p.length
            assert at <= 1024 and at & (at - 1) == 0
            short += at < 1024
        if hold > 3_000:
            assert short <= 10 * frame.rdd.getNumPartitions()
        want = Counter()
        for (i, t), n in texts.items():
            want[i, tuple(lib.encode(t, add_special_tokens=False).ids + [2])] += n
        got = Counter()
        for i, ps in per.items():
            if i == 10:  # the same document twice
                assert sorted(x for p in ps for x in p[1]) == sorted(2 * [*lib.encode("same", add_special_tokens=False).ids, 2])
                continue
            ps.sort()
            got[i, tuple(x for p in ps for x in p[1])] += 1
            assert ps[0][0] == 0 and {p[2] for p in ps} == {sum(len(p[1]) for p in ps)}
        assert got == Counter({k: v for k, v in want.items() if k[0] != 10})
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_levels_choose_least_squares():
    """Every placement is the best by brute force."""
    rnd = random.Random(3)
    levels = packing.Levels(16)
    for _ in range(400):
        s = rnd.randint(1, 15)
        before = levels.count.copy()
        levels.place((0, 0, b"\0" * 4 * s, s))
        cost = lambda c: sum(int(x) ** 2 for h, x in enumerate(c) if 0 < h < 16)
        options = []
        for h in range(16):
            if h == 0 or before[h] and h + s <= 16:
                c = before.copy()
                c[h] -= h > 0
                c[h + s] += 1
                options.append(cost(c))
        assert cost(levels.count) == min(options)


# 7, 8


def planted(n=600):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(("ta", "re", "no", "mi", "su", "le")) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(30, 120))]
        junk, rude = i % 4 == 0, i % 5 == 1
        if junk:
            words = [w for w in words[:20] for _ in range(6)] if i % 8 else [w + "###" for w in words]
        if rude:
            for k in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(("grobnik", "fulsterous", "zekwat")))
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, 1 if rude else 0))
    docs += [(n, None), (n + 1, ""), (n + 2, "x " * 70_000), (n + 3, "you are a grobnyk and a fulstereous fool"), (n + 4, 'he said the word "grobnik" today'), (None, "no id")]
    labels += [(n + 9, None, None), (None, 1, 0), (n, None, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    d, l = planted()
    return spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(l, "doc_id long, quality int, toxic int"), dict(d), {x[0]: x for x in l}


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality(spark, labelled):
    docs, labels, texts, marks = labelled
    got = quality.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    held = [r for r in got if r.held_out and marks.get(r.doc_id, (0, None))[1] is not None]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = sum(r.predicted == marks[r.doc_id][1] for r in held)
    assert len(held) > 150 and right >= 0.97 * len(held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    none = labels.where("quality > 5")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score(docs.where("false"), labels).count() == 0


def test_quality_matches_densities(labelled):
    """The kept factors give the plain Gaussian formula."""
    docs, labels, _, _ = labelled
    found = quality.features(docs)
    model = quality.fit(found, labels)
    x = np.array([r.x for r in found.limit(20).collect()])
    dens = []
    for p, m, f in zip(model.priors, model.means, model.factors):
        cov = np.linalg.inv(f.T @ f)
        dens.append([p - 0.5 * (v - m) @ np.linalg.solve(cov, v - m) - 0.5 * np.linalg.slogdet(cov)[1] for v in x])
    want = 1 / (1 + np.exp(np.clip(np.array(dens[0]) - np.array(dens[1]), -700, 700)))
    assert np.allclose(model.scores(x.tolist()), want, atol=1e-9)


def test_toxicity(labelled):
    docs, labels, texts, marks = labelled
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and marks.get(r.doc_id, (0, 0, None))[2] is not None and r.doc_id < 600]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got.values() if r.doc_id is not None)
    right = sum(r.predicted == marks[r.doc_id][2] for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert got[603].hits == 2 and got[603].predicted == 1
    assert got[604].hits == 1 and got[604].score < got[603].score
    assert got[600].score == got[601].score < 0.3
    assert toxicity.score(docs.where("false"), labels).count() == 0
    assert max(r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()) < 0.01


def edit_distance(a, b):
    # Letters more, less or other, and neighbours swapped.
    rows = [list(range(len(b) + 1))]
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != d)))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_is_edit_distance():
    rnd = random.Random(6)
    letters = "abcd"
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    terms = {word(rnd.randint(3, 13)): rnd.random() for _ in range(40)}
    lex = toxicity.Lexicon(terms, {})
    for _ in range(4000):
        w = word(rnd.randint(1, 14))
        if rnd.random() < 0.6:
            t = list(rnd.choice(list(terms)))
            for _ in range(rnd.randint(0, 3)):
                t.insert(rnd.randrange(len(t) + 1), rnd.choice(letters)) if rnd.random() < 0.5 else t and t.pop(rnd.randrange(len(t)))
            w = "".join(t)
        near = [(edit_distance(w, t), -x, t) for t, x in terms.items() if lex.edits(t)]
        near = [n for n in near if n[0] <= lex.edits(n[2])]
        want = (min(near)[0], min(near)[2]) if near else None
        assert lex.near(w) == want


# 9


@pytest.mark.parametrize("rows", [7, 4096])
def test_top_k(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "ROWS", rows)
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(300)]
    data += [(i, data[3][1]) for i in range(300, 340)] + [(400, None), (500, [1.0, None]), (600, [float("nan")] * 12), (700, [float("inf")] * 12),
            (800, []), (900, [0.5]), (None, data[0][1]), (1000, [0.0] * 12), (1001, [-3.0] * 12)]
    got = topk.search_table(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3), "vec_id % 100 = 0", 10).collect()
    good = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in data
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, q in good:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:10]
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_chunks_and_few_rows(spark):
    data = [(i, [float(i % 7), 1.0]) for i in range(0, 500, 50)]
    rows = topk.scaled(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    index = topk.build_index(rows)
    want = {tuple(r) for r in topk.top_k(rows, index, 3).collect()}
    assert len(want) == 30 and {tuple(r) for r in topk.top_k(rows, index, 3, chunk=4).collect()} == want
    assert topk.search_table(spark.createDataFrame(data[:1], "vec_id long, embedding array<double>"), "true").count() == 0


# 10


def test_main_text(spark):
    menu = "<nav><a href=/>Home</a></nav>"
    tip = "<div><div>Never miss a thing</div><div>Join us today</div></div>"
    page = lambda body, html=None: html or f"<!doctype html><html><head><title>T</title><script>x='<p>no</p>'</script></head><body>{menu}{body}</body></html>"
    rows = [(1, "http://a/1", page("<article><header>By me</header><h1>A &amp; B</h1><p>One <b>two</b><br>three&nbsp;x<p>Four<div class='ad box'>Buy</div>"
                                   "<ul><li>i<li>ii</ul><section id=comments><p>lol</p></section><form><input><p>f</p></form></article><footer>&copy;</footer>")),
            (2, "http://a/2", None), (3, None, ""), (4, "http://a/4", "plain < text &lt;p&gt; &am"), (5, "x", page("<div>body only</div><aside>s</aside><p hidden>h</p>")),
            (5, "x", page("<div>body only</div><aside>s</aside><p hidden>h</p>")), (6, "http://a/6", "<article><p>cut <b>off</b> her"), (7, "http://a/7", "<article><p>cut <a href='x"),
            (8, "http://a/8", "<nav><ul><li>m<article><p>kept</article>"),
            (10, "http://a/10", "<article><p>be<i>fore</i> <span class=ad><span>buy</span> now</span>af<b>ter</b></p><label>l</label></article>"), (9, "http://a/9", "<p>" + "w " * 50_000 + "</p>")]
    rows += [(100 + i, "http://www.T.org:80/%d" % i, page(f"<div>Story {i}</div><p>Same opening line</p><p>About {i * i}</p>{tip}")) for i in range(30)]
    rows += [(200 + i, "http://c.org/%d" % i, page("<div>copied page</div><p>all the same</p>")) for i in range(30)]
    rows += [(300 + i, "http://d.org/%d" % i, page(f"<article><p>Shared first line</p><p>No {i}</p>{tip}</article>")) for i in range(30)]
    got = Counter((r.page_id, r.text) for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    want = {1: "A & B\n\nOne two three x\n\nFour\n\ni\n\nii", 2: "", 3: "", 4: "plain < text <p> &am", 5: "body only", 6: "cut off her", 7: "cut", 8: "kept", 10: "before after", 9: ("w " * 50_000).strip()}
    want |= {100 + i: f"Story {i}\n\nAbout {i * i}" for i in range(30)} | {200 + i: "copied page\n\nall the same" for i in range(30)}
    want |= {300 + i: f"Shared first line\n\nNo {i}" for i in range(30)}
    assert got == Counter((r[0], want[r[0]]) for r in rows)
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_counts_parts_that_name_their_role(spark):
    rows = [(i, "http://n.org/%d" % i, f"<body><nav><ul><li>Home<li>News</ul></nav><div class=ad>Buy {i}</div><article><p>Same line</p><p>No {i}</p></article></body>") for i in range(30)]
    got = {tuple(r) for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text", "n_removed").collect()}
    assert got == {(i, f"Same line\n\nNo {i}", 2) for i in range(30)}


def test_main_text_templates_of_sections_and_small_hosts(spark):
    side = lambda s: f"<div><ul><li>{s} news<li>{s} team</ul></div><div><div>Follow our {s} desk</div></div>"
    story = "<div><p>" + "The very same story is told here " * 8 + "</p></div>"
    page = lambda s, i: f"<body>{side(s)}<article><p>Same line</p><p>No {s} {i}</p></article></body>"
    body = lambda s, i: f"<body>{side(s)}<div><p>Same line</p><p>No {s} {i}</p></div></body>"
    parts = ["sport", "money", "art", "food"]
    rows = [(1000 * k + i, f"http://big.org/{s}/{i}", body(s, i), f"No {s} {i}") for k, s in enumerate(parts) for i in range(15)]
    rows += [(9000 + i, f"http://small.org/{i}", body("all", i), f"Same line\n\nNo all {i}") for i in range(4)]
    rows += [(9100 + i, f"http://news.org/{i}", page("top", i), f"Same line\n\nNo top {i}") for i in range(5)]
    rows += [(9200 + i, f"http://story.org/{i}", f"<body><div>Only here {i}</div>{story}</body>", f"Only here {i}\n\n" + ("The very same story is told here " * 8).strip()) for i in range(5)]
    got = html_main.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(r[0], r[3]) for r in rows}


def test_main_text_keeps_a_story_beside_a_teaser(spark):
    teaser = "<article><h2>Read next</h2></article>"
    rows = [(i, "http://t.org/%d" % i, f"<body><nav>Home</nav><div id=story><p>Story {i} of many words</p></div>{teaser}</body>") for i in range(4)]
    got = {tuple(r) for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()}
    assert got == {(i, f"Story {i} of many words\n\nRead next") for i in range(4)}


def test_toxicity_words_are_not_crowded_out_by_beginnings(spark, caplog):
    docs = [(i, ("plain today", "vilewords today", "plain today", "vilewordz today")[i % 4]) for i in range(400)]
    labels = [(i, i % 2) for i in range(400)]
    with caplog.at_level("WARNING"):
        lexicon = toxicity.learn(spark.createDataFrame(docs + [(1000, "x")], "doc_id long, text string"),
                                 spark.createDataFrame(labels, "doc_id long, toxic int"), most_terms=1)[0]
    # Every beginning stands in more documents than either word.
    assert {"vilewords", "vilewordz"} <= set(lexicon.terms)
    assert "beginnings beyond the bound of 2" in caplog.text


# pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(stage(spark, seen[-1], sf))
    rows = [s.collect() for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    scores = {r.doc_id: r.predicted for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in rows[1]} == {i for i, p in scores.items() if p}
    first = {}
    for r in rows[1]:
        key = r.text.translate(LOW)
        first[key] = min(r.doc_id, first.get(key, r.doc_id))
    assert {r.doc_id for r in rows[2]} == set(first.values())
    groups = jaccard_groups([(r.doc_id, r.text) for r in rows[2]], 5, 4, 5)
    assert {r.doc_id for r in rows[3]} == {i for i, _, root in groups if i == root}
    copies = {r.doc_id: r.copies for r in mixing.mixed(seen[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in rows[4]) == Counter(copies)
    done = P.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n // r.t for r in done} == copies and all(r.n % r.t == 0 for r in done)
