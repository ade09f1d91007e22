"""Alignment of two tokenizers' tokens over a corpus, counted by inverted pair bitmaps.

Documents are numbered within chunks. For every pair of ids (A, B) whose tokens end together somewhere, a chunk holds a
compressed bitmap of the documents with that link, and planes: plane k marks the documents whose number of links less one has
bit k set. A pair's bitmap is the OR of its chunks' containers, so popcounts of the containers add up to document counts and, with the planes'
weights, to link counts. Scores go back to the documents through the same postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.common import column, runs, tidy
from assaygrid.llm.words import slices, sums_by_text, take_runs, text_bytes
from assaygrid.session import cut

# A chunk's document numbers fit 16 bits; a container is an array of them up to ARRAY numbers and a bitmap beyond.
CHUNK, ARRAY = 1 << 16, 4095
PRESENT = -1


def pack_container(numbers) -> bytes:
    """Sorted 16-bit numbers as an array, or as a bitmap of 8,192 bytes if more than ARRAY."""
    import numpy as np

    if len(numbers) <= ARRAY:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, dtype=np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_container(data: bytes):
    import numpy as np

    if len(data) < CHUNK // 8:
        return np.frombuffer(data, dtype="<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little"))


def container_size(data: bytes) -> int:
    return len(data) // 2 if len(data) < CHUNK // 8 else int.from_bytes(data, "little").bit_count()


def units(texts):
    """(codes, counts, distinct): texts with a space put before, cut into units no token of either tokenizer crosses.

    A unit begins at a single or first space behind a character that is surely no white space, so neither a merge nor the
    splitting pattern looks across its bounds. Null and empty texts have none.
    """
    import numpy as np
    import pyarrow as pa

    given, bounds = text_bytes(texts)
    filled = np.diff(bounds) > 0
    shift = np.cumsum(filled)
    start = bounds[:-1] + shift - filled
    raw = np.full(len(given) + int(filled.sum()), 32, dtype=np.uint8)
    inside = np.ones(len(raw), dtype=bool)
    inside[start[filled]] = False
    raw[inside] = given
    begin = raw == 32
    before, second = raw[:-1], np.concatenate((np.zeros(1, np.uint8), raw[:-2])) if len(raw) > 1 else raw[:0]
    plain = (before > 32) & (before < 127)
    latin = (before >= 0x80) & (second >= 0xC3) & (second <= 0xDF)
    begin[1:] &= plain | latin
    # A space that ends a text stays with the unit before it.
    stops = start[filled] + np.diff(bounds)[filled]
    begin[stops] = False
    begin[start[filled]] = True
    at = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(at, np.append(start, len(raw))))
    cuts = np.append(at, len(raw)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
    return coded.indices.to_numpy(), counts, coded.dictionary


class Pair:
    """Both tokenizers, and what they make of a unit: token counts, links and the text of its groups."""

    def __init__(self, bytes_path: str, pieces_path: str, remember: int = 60_000):
        import json

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(bytes_path), sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a.encode_special_tokens = True
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte = {chr(b): b for b in seen} | dict(zip(map(chr, range(256, 512)), (b for b in range(256) if b not in seen)))
        vocabulary = json.load(open(bytes_path, encoding="utf-8"))["model"]["vocab"]
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.a_bytes = table(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = table([b"%d," % i for i in range(max(len(tokens), len(pieces)))])
        self.remember, self.known = remember, {}
        self.numbers = np.zeros((4, 0), dtype=np.int64)  # rows: tokens of A, of B, links, 1 if the bytes agree
        self.links, self.starts, self.texts = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def fresh(self, words: list[str]):
        """(numbers, links, starts, texts) of new units."""
        import numpy as np

        (a, n_a), (b, n_b) = (flat_ids(words, f) for f in (
            lambda some: [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)], lambda some: self.b.encode([w[1:] for w in some], num_threads=1)))
        want = [w.encode("utf-8", "surrogatepass") for w in words]
        agree = np.array([w == x == y for w, x, y in zip(want, spell(self.a_bytes, a, n_a), spell(self.b_bytes, b, n_b))], dtype=bool)
        a, b = a[np.repeat(agree, n_a)], b[np.repeat(agree, n_b)]
        n_a, n_b = n_a * agree, n_b * agree
        # Units agree byte by byte, so both id sequences run over the same bytes.
        end_a, end_b = np.cumsum(self.a_bytes[1][a]), np.cumsum(self.b_bytes[1][b])
        ends, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        links = a[at_a] << 32 | b[at_b]
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        n_links = np.searchsorted(at_a, last_a) - np.searchsorted(at_a, last_a - n_a)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        ids = np.concatenate((a, b))[order]
        flat, lengths, firsts = self.digits
        at, each = take_runs(lengths, ids, firsts)
        text = flat[at]
        stop = np.cumsum(each)
        mark = np.concatenate((np.zeros(len(a), np.uint8), np.zeros(len(b), np.uint8)))
        mark[at_a], mark[len(a) + at_b] = 124, 59
        mark = mark[order]
        text[stop[mark > 0] - 1] = mark[mark > 0]
        # A unit's tokens of both kinds are neighbours in this order.
        upto = np.concatenate(([0], stop))[np.cumsum(n_a + n_b)]
        text = text.tobytes()
        texts = [text[i:j] for i, j in zip(np.concatenate(([0], upto[:-1])).tolist(), upto.tolist())]
        return np.stack((n_a, n_b, n_links, agree.astype(np.int64))), links, np.cumsum(n_links) - n_links, texts

    def look_up(self, words: list[str]):
        """(numbers, links, starts, texts) of distinct units."""
        from itertools import repeat

        import numpy as np

        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.numbers[:, at], self.links, self.starts[at], [self.texts[i] for i in at.tolist()]
        numbers, links, starts, texts = self.fresh([words[i] for i in new])
        at[new] = len(self.known) + np.arange(len(new))
        numbers, starts = np.concatenate((self.numbers, numbers), axis=1), np.concatenate((self.starts, starts + len(self.links)))
        links, texts = np.concatenate((self.links, links)), self.texts + texts
        room = self.remember - len(self.known)
        if room > 0:
            self.known.update(zip([words[i] for i in new[:room]], at[new[:room]].tolist()))
            kept = len(self.known)
            self.numbers, self.links, self.starts, self.texts = numbers[:, :kept], links, starts[:kept], texts[:kept]
        return numbers[:, at], links, starts[at], [texts[i] for i in at.tolist()]


def flat_ids(words, encode, most: int = 2048):
    """(ids of all words in a row, number of each), a few words at a time, for the libraries' results are large."""
    import numpy as np

    flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), most):
        ids = encode(words[i:i + most])
        counts.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        flat.append(np.fromiter((t for x in ids for t in x), dtype=np.int64, count=int(counts[-1].sum())))
    return np.concatenate(flat), np.concatenate(counts)


def both_tokenizers(bytes_path: str, pieces_path: str) -> Pair:
    """One per worker process, so tasks that follow each other share tokenizers and remembered units."""
    import sys

    kept = sys.modules.setdefault("_aligned_tokenizers", {})
    if (bytes_path, pieces_path) not in kept:
        kept.clear()
        kept[bytes_path, pieces_path] = Pair(bytes_path, pieces_path)
    return kept[bytes_path, pieces_path]


def table(rows: list[bytes]):
    """(flat bytes, lengths, starts) of byte strings."""
    import numpy as np

    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.frombuffer(b"".join(rows), dtype=np.uint8), lengths, np.cumsum(lengths) - lengths


def spell(rows, ids, counts) -> list[bytes]:
    """Joined bytes of the tokens of each unit."""
    import numpy as np

    at, each = take_runs(rows[1], ids, rows[2])
    flat, ends = rows[0][at].tobytes(), np.concatenate(([0], np.cumsum(sums_by_text(each, counts)))).tolist()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def postings(pairs, documents, times):
    """Containers of one chunk as (pairs, planes, containers), from distinct (pair, document) with their numbers of links."""
    import numpy as np

    order = np.lexsort((documents, pairs))
    pairs, documents, more = pairs[order], documents[order], times[order] - 1
    out_pairs, out_planes, out_data = [], [], []
    top = int(more.max()).bit_length() if len(more) else 0
    for plane in range(PRESENT, top):
        chosen = slice(None) if plane == PRESENT else (more >> plane & 1).astype(bool)
        p, d = pairs[chosen], documents[chosen]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        stops = np.append(first[1:], len(p))
        flat = d.astype("<u2").tobytes()
        out_pairs.append(p[first])
        out_planes.append(np.full(len(first), plane, dtype=np.int32))
        out_data += [flat[2 * i:2 * j] if j - i <= ARRAY else pack_container(d[i:j]) for i, j in zip(first.tolist(), stops.tolist())]
    return np.concatenate(out_pairs), np.concatenate(out_planes), out_data


SCHEMA = "doc_id long, chunk long, number int, n_a long, n_b long, n_links long, groups string, groups_sha256 string, pair long, plane int, docs binary"


def indexed(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str, text_col: str, with_groups: bool, hold: int = 500_000) -> DataFrame:
    """A row per document (plane is null) and a row per container."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]
        both, chunk, number = both_tokenizers(bytes_path, pieces_path), TaskContext.get().partitionId() << 32, 0
        held, weight = [], 0

        def batch_of(n, **cols):
            arrays = [pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in zip(names, types)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def flush():
            pairs, planes, data = postings(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(pairs), 50_000):
                some = pairs[i:i + 50_000]
                yield batch_of(len(some), chunk=np.full(len(some), chunk), pair=some, plane=planes[i:i + 50_000], docs=data[i:i + 50_000])

        for batch in slices(batches, most=1 << 20):
            codes, counts, distinct = units(batch.column(1))
            numbers, links, starts, texts = both.look_up(distinct.to_pylist())
            n_a, n_b, n_links, agree = (sums_by_text(x[codes], counts) for x in numbers)
            good = (agree == counts) & (counts > 0)
            begin, groups, shas = 0, [], []
            for n, g in zip(counts.tolist(), good.tolist()):
                text = b"".join([texts[c] for c in codes[begin:begin + n].tolist()])[:-1] if g else b""
                begin += n
                groups.append(text.decode() if with_groups else None)
                shas.append(hashlib.sha256(text).hexdigest() if g else "")
            # Links of the documents that count, once a pair and document.
            fine = np.repeat(good, counts)
            at, each = take_runs(numbers[2], codes[fine], starts)
            owner = np.repeat(np.repeat(np.arange(len(counts)), counts)[fine], each)
            done = 0
            while done < len(counts):
                some = min(len(counts) - done, CHUNK - number)
                mine = (owner >= done) & (owner < done + some)
                pair, inverse = np.unique(links[at[mine]], return_inverse=True)
                key, times = np.unique(inverse * some + (owner[mine] - done), return_counts=True)
                held.append((pair[key // some] if len(key) else pair, (key % some + number).astype(np.int32), times.astype(np.int32)))
                weight += len(key)
                part = slice(done, done + some)
                yield batch_of(some, doc_id=batch.column(0).slice(done, some), chunk=np.full(some, chunk), number=np.arange(number, number + some, dtype=np.int32),
                               n_a=(n_a * good)[part], n_b=(n_b * good)[part], n_links=(n_links * good)[part], groups=groups[part], groups_sha256=shas[part])
                number += some
                done += some
                if number == CHUNK or weight > hold:
                    yield from flush()
                    held, weight, number, chunk = [], 0, 0, chunk + 1
        if held:
            yield from flush()
        held = []
        tidy()

    pair = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return pair.mapInArrow(run, SCHEMA)


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, documents, links): popcounts of the pair's containers, summed over its chunks."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size = np.fromiter(map(container_size, batch.column(2).to_pylist()), dtype=np.int64, count=batch.num_rows)
            plane = batch.column(1).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.where(plane == PRESENT, size, 0)), pa.array(size << np.maximum(plane, 0))], ["pair", "documents", "links"])

    sizes = index.where("plane is not null").select("pair", "plane", "docs").mapInArrow(run, "pair long, documents long, links long")
    return sizes.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def returned(index: DataFrame, scores: DataFrame) -> DataFrame:
    """(chunk, number, n_best, count_sum): every posting gives its pair's score to its documents. `scores` is (pair, links, best)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out():
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now)), pa.array(some.astype(np.int32)), pa.array(best[some]), pa.array(total[some])],
                                              ["chunk", "number", "n_best", "count_sum"])

        now, best, total = None, None, None
        for (chunk,), rows in runs(batches, ["chunk"], whole=False):
            if chunk != now:
                if now is not None:
                    yield out()
                now, best, total = chunk, np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
            found = [unpack_container(d) for d in rows.column("docs").to_pylist()]
            each = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            numbers = np.concatenate(found).astype(np.int64)
            weight = np.int64(1) << np.maximum(rows.column("plane").to_numpy().astype(np.int64), 0)
            np.add.at(total, numbers, np.repeat(weight * rows.column("links").to_numpy(), each))
            np.add.at(best, numbers, np.repeat(weight * rows.column("best").to_numpy(), each))
        if now is not None:
            yield out()

    rows = index.where("plane is not null").select("pair", "chunk", "plane", "docs").join(scores, "pair").select("chunk", "plane", "docs", "links", "best")
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, number int, n_best long, count_sum long")


def align(
    docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the alignment of a byte-level tokenizer A and a piece tokenizer B.

    A reads a space and the text, B the text, before which it puts the space itself. Where tokens of both end together
    they are linked, and such ends cut a document's tokens into groups. `pairs` is (pair, a, b, documents, links, best): the
    pair's counts over all documents, best where no pair with the same B id has more links. `documents` has a row a
    document: doc_id, n_a, n_b, n_links (as many as groups), n_best (links of best pairs), count_sum (sum of the pairs' links over the
    document's links), groups_sha256 of `a1,a2|b1;a3|b2,b3`, and the text itself as groups if asked for. Null and empty texts, and texts
    that B does not give back byte by byte (it takes U+2581 for a space), have no tokens: zeros and ''. Rows are
    independent: null and repeated ids stay, other columns are ignored, no rows give no rows.
    """
    index = cut(indexed(docs, bytes_path, pieces_path, id_col, text_col, with_groups), "alignment-index")
    counts = cut(pair_counts(index), "alignment-pairs")
    highest = counts.groupBy(F.expr("pair & 4294967295").alias("b")).agg(F.max("links").alias("highest"))
    scores = counts.withColumn("b", F.expr("pair & 4294967295")).join(highest, "b").select(
        "pair", F.shiftright("pair", 32).alias("a"), "b", "documents", "links", (F.col("links") == F.col("highest")).cast("long").alias("best"))
    back = returned(index, scores.select("pair", "links", "best"))
    documents = index.where("plane is null").drop("pair", "plane", "docs").join(back, ["chunk", "number"], "left")
    kept = ["doc_id", "n_a", "n_b", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"]
    return documents.select(*kept, *(["groups"] if with_groups else [])), scores
