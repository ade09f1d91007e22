"""Runs of repeated words against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from assaygrid.llm import queries
from assaygrid.llm.periodic import periodic_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, exponent=4):
    """Every maximal stretch by every period, smaller periods first to tell a stretch's smallest."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, exponent * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out)


def test_runs_of_sequences():
    rnd = random.Random(8)
    for _ in range(1500):
        k, n = rnd.choice((1, 2, 2, 3, 5)), rnd.randrange(60)
        w = [rnd.randrange(k) for _ in range(n)]
        if n > 4 and rnd.random() < 0.5:
            p, a = rnd.randrange(1, max(2, n // 4)), rnd.randrange(n // 2)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert runs_of(w) == brute(w)
    assert runs_of([7] * 30_000) == [(0, 30_000, 1)]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def awkward():
    rnd = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a a a a a a a"), (None, "x y"), (7, "b " * 6), (7, "b " * 6), (8, "b " * 5),
            (9, "p q r s " * 4 + "p q"), (10, "\x0bno break " * 9), (11, "a b a b a b a b\x0ca\x1cb a b"), (12, "é　é " * 12),
            (13, "long " * 9000 + "tail"), (14, " ".join(str(i % 700) for i in range(9000)))]
    rows += [(1000 + i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(90)))) for i in range(300)]
    rows += [(2000 + i, " ".join(rnd.choice(["x", "y z", "w\nv u"]) * rnd.randrange(1, 9) for _ in range(9))) for i in range(150)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("periodic")
    spark.createDataFrame([(i, t, "a", 1) for i, t in awkward()], "doc_id long, text string, runs string, collapsed int").repartition(3).write.parquet(
        f"{path}/documents.parquet")
    return str(path)


def test_query_against_brute_force(spark, folder):
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()]
    # Very long texts have known runs; all others are compared whole.
    rest = {i for i, t in awkward() if len(t or "") >= 20_000}
    by_id = {r[0]: r for r in got if r[0] in rest}
    assert by_id[13][1:6] == (1, 0, 9000, 1, 9_000_000)
    assert by_id[14][1:6] == (1, 0, 9000, 700, 12857)
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((r for r in got if r[0] not in rest), key=key) == sorted((expected(i, t) for i, t in awkward() if i not in rest), key=key)


def test_spans_texts_and_empty_tables(spark):
    rows = [(1, "go on " * 5 + "then stop", 0)]
    frame = spark.createDataFrame(rows, "id long, body string, doc_id int")
    found = periodic_runs(frame, "id", "body").collect()
    assert [tuple(r) for r in found[0]["runs"]] == [(0, 10, 2)]
    assert found[0]["collapsed"] == "go on then stop"
    assert periodic_runs(frame.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame, "id", "body", exponent=2)
