"""Candidate groups of unlike documents that share passages: cut up before they are verified, without losing a link."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.llm import ngram_join
from tests.llm.test_llm import DOCS, jaccard_groups


def passages():
    """Documents that are half a passage of all, and near copies of every sixth."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(30)]
    rows = []
    for i in range(60):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(base + own), "a"))
        if i % 6 == 0:
            rows.append((100 + i, " ".join(base + own[:-1]), "a"))
    return rows


def test_groups_of_shared_passages_are_cut_up(spark, monkeypatch):
    rows = passages()
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    real, seen = ngram_join.verified_links, []

    def spy(docs, members, *rest):
        seen.append(max([r["count"] for r in members.groupBy("root").count().collect()], default=0))
        return real(docs, members, *rest)

    monkeypatch.setattr(ngram_join, "verified_links", spy)
    # No shingle is known to be common, as with passages that few of very many documents share.
    monkeypatch.setattr(ngram_join, "common_shingles", lambda *a, **k: np.zeros(0, np.uint64))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    got = {tuple(r) for r in ngram_join.jaccard_components(frame, 3, 4, 5).collect()}
    assert got == jaccard_groups([r[:2] for r in rows], 3, 4, 5)
    assert seen == [2]


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (1, 2)])
def test_rare_prefixes_of_linked_sets_meet(num, den):
    rng = np.random.default_rng(6)
    often = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    times = rng.integers(3, 9, len(often))
    hit = 0
    for _ in range(3000):
        s = np.unique(np.concatenate((rng.integers(0, 2**63, int(rng.integers(1, 40))).astype(np.uint64), rng.choice(often, int(rng.integers(0, 50))))))
        t = s[rng.random(len(s)) > rng.random() * (1 - num / den)]
        t = np.unique(np.concatenate((t, rng.choice(often, int(rng.integers(0, 4))), rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64))))
        both = len(np.intersect1d(s, t))
        if len(t) and den * both >= num * (len(s) + len(t) - both):
            hit += 1
            for known in ((often, times), (often[:0], times[:0])):
                assert np.intersect1d(ngram_join.rare_prefix(s, *known, num, den), ngram_join.rare_prefix(t, *known, num, den)).size
    assert hit > 300


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_split_by_ids(spark, monkeypatch, bits):
    """Wanted ids are all on the first side, null ids and repeated ones included in one of the two."""
    monkeypatch.setattr(ngram_join, "WANTED_BITS", bits)
    docs = spark.createDataFrame([(None, "n")] + [(i % 900 - 300, str(i)) for i in range(1000)], "doc_id long, text string")
    some, rest = ngram_join.split_by_ids(docs, spark.range(-300, -200).select(F.col("id").alias("doc_id")), "doc_id")
    assert some.columns == rest.columns == docs.columns
    a, b = [r.text for r in some.collect()], [r.text for r in rest.collect()]
    assert sorted(a + b) == sorted(r.text for r in docs.collect())
    assert {str(i) for i in range(1000) if i % 900 < 100} <= set(a)
    assert bits < 100 or len(a) == 200
    none, every = ngram_join.split_by_ids(docs, spark.range(0).select(F.col("id").alias("doc_id")), "doc_id")
    assert none.count() == 0 and every.count() == 1001


@pytest.mark.parametrize("n,top", [(0, 46), (1, 46), (500, 30), (500, 46), (3, 46)])
def test_packed_hashes(n, top):
    """Sorted hashes come back from their gaps, long gaps and repeated hashes included."""
    x = np.sort(np.random.default_rng(n).integers(0, 2**top, n).astype(np.uint64))
    x = np.sort(np.concatenate((x, x[:2])))
    raw = ngram_join.packed_gaps(np.diff(x, prepend=np.uint64(0)))
    assert (ngram_join.unpacked_gaps(raw, len(x)) == x).all()
    assert top > 30 or len(raw) == 8 + 4 * (len(x) - 1) + 1
