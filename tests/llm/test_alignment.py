"""Alignment of two tokenizers against whole-text encoding and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from assaygrid.llm import alignment, queries

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")

ROWS = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "a "), (6, "one two  three   "), (7, "one two three"), (8, "x\n\n  y \t z  w"), (9, "a▁b"),
        (10, "<|endoftext|> </s> <0x0A> <unk>"), (None, "né à côté. Être"), (12, "日本 語　です ok"), (12, "it's don't we'll 123 4.5"), (13, "  em \U0001f600 x"),
        (14, "the the the the the the"), (15, "\x00 nul \x1c sep"), (16, "é̂ ﬁ İ" * 3), (17, "long " * 20_000 + "end"), (18, "q" * 3000),
        (19, "É " * 40), (20, "\r\n a\x0b b\x85 c  d")]


def brute(rows):
    import json

    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    codes = {}
    for x in range(0x250):  # the byte behind each sign of the byte-level alphabet
        for sign, byte in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(x))[0][0] if x else "Ā", chr(x).encode()):
            codes[sign] = byte
    for byte in range(256):
        if byte not in codes.values():  # bytes that no text of two-byte characters holds
            codes[chr(byte)] = byte
    docs = []
    for i, t in rows:
        none = (i, [], [], [])
        if not t:
            docs.append(none)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xs = [bytes(codes[c] for c in names[k]) for k in x]
        ys = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        want = (" " + t).encode()
        if b"".join(xs) != want or b"".join(ys) != want:
            docs.append(none)
            continue
        ends = np.intersect1d(np.cumsum([len(k) for k in xs]), np.cumsum([len(k) for k in ys]))
        groups, p, q = [], 0, 0
        at_x, at_y = np.cumsum([len(k) for k in xs]).tolist(), np.cumsum([len(k) for k in ys]).tolist()
        for e in ends.tolist():
            u, v = at_x.index(e, p) + 1, at_y.index(e, q) + 1
            groups.append((x[p:u], y[q:v]))
            p, q = u, v
        docs.append((i, x, y, groups))
    count, docs_of = Counter((g[0][-1], g[1][-1]) for d in docs for g in d[3]), defaultdict(set)
    for k, d in enumerate(docs):
        for g in d[3]:
            docs_of[g[0][-1], g[1][-1]].add(k)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for i, x, y, groups in docs:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, count, {k: len(v) for k, v in docs_of.items()}


KEY = lambda r: (r[0] is None, r[0] or 0, r[-1])


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("alignment")
    rows = ROWS + [(100 + r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, chunk int, pair string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_query_against_brute_force(spark, folder):
    path, rows = folder
    got = [tuple(r) for r in queries.QUERIES["op12_token_alignment"](spark, path).collect()]
    assert sorted(got, key=KEY) == sorted(brute(rows)[0], key=KEY)


def test_pairs_groups_and_small_pools(spark, folder, monkeypatch):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want, count, documents = brute(rows)
    whole = alignment.indexed
    monkeypatch.setattr(alignment, "indexed", lambda *a: whole(*a, hold=500))
    found, pairs = alignment.align(docs, A, B, with_groups=True)
    assert {(r["a"], r["b"]): (r["links"], r["documents"]) for r in pairs.collect()} == {k: (n, documents[k]) for k, n in count.items()}
    for r in found.collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    assert sorted((r["doc_id"], r["n_a"], r["count_sum"]) for r in found.where("doc_id is not null").collect()) == sorted((w[0], w[1], w[6]) for w in want if w[0] is not None)


def test_containers_and_empty_tables(spark):
    for n in (1, alignment.ARRAY, alignment.ARRAY + 1, alignment.CHUNK):
        numbers = np.sort(np.random.default_rng(n).permutation(alignment.CHUNK)[:n])
        data = alignment.pack_container(numbers)
        assert np.array_equal(alignment.unpack_container(data), numbers) and alignment.container_size(data) == n
    found, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.count() == pairs.count() == 0
