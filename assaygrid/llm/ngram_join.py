"""Exact Jaccard join of documents on word n-grams by universe partition and pigeonhole.

Shingles are hashed into the segments of a size band. Two sets whose difference is at most H agree on
one of H + 1 segments; a segment allowed one difference counts for two. So each set is indexed
under hashes of its segments and, where the cost model gives a segment one difference, under its
one-deletion neighbourhood. Sets that share a hash are candidates. Candidate groups too large for one
block are cut up by prefixes of rare shingles; groups are then verified exactly and whole, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.common import column, runs, tidy
from assaygrid.llm.components import components
from assaygrid.session import cut

# Multipliers of the hashes: odd numbers of 64 bits; the second inverts the first.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
# A hash with up to FEW keys gives all their pairs.
FEW = 16
# Hashes are shuffled by their first bits, so many that unlike ones seldom meet. A reduce task gets about so many, in rows of so many at most.
HASH_BITS, TASK_HASHES, ROW_HASHES = 46, 1_000_000, 4096
# A candidate group is verified in blocks of at most this many sets and about this many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_000_000
# Bits that hold which ids are wanted (2 MB), and shingles of the sample that tells which of them are frequent in large groups.
WANTED_BITS, ORDER_SHINGLES = 1 << 24, 8_000_000


@dataclass(frozen=True)
class Band:
    """Sets of low..high shingles are joined with sets of low..reach; `exact` segments, then `loose` ones with one difference."""

    number: int
    low: int
    high: int
    reach: int
    exact: int
    loose: int
    spare: int = 1


def bands(up_to: int, num: int, den: int, crowd: float, alike: float) -> list[Band]:
    """Size bands whose ends are a factor of den / num apart, for Jaccard >= num / den.

    For sizes y <= x the difference is at most (den - num)(x + y) / (den + num). Every allocation has
    exact + 2 * loose = H + 1 + spare: `spare` further agreements let sets leave out as many empty
    segments, and as many are taken as all but about one set in a thousand need. The model takes the split
    with the least cost: hashes emitted, plus candidates expected from `crowd` documents that share a
    fraction `alike` of their shingles.
    """
    import math

    out, low = [], 1
    while low <= up_to:
        high = max(low, low * den // num)
        reach = high * den // num
        base = (den - num) * (high + reach) // (den + num) + 1

        def cost(loose, need):
            segments = need - loose
            size = high / segments
            emitted = segments - loose + loose * (1 + size)
            chance = (segments - loose) * alike**size + loose * (size + 1) * alike ** max(size - 1, 0)
            return emitted + crowd * chance

        spare = 1
        while True:
            need = base + spare
            loose = min({need // 2 * i // 32 for i in range(33)}, key=lambda k: cost(k, need))
            empty = (need - loose) * math.exp(-low / (need - loose))
            more = min(1 + low // 2, math.ceil(empty + 3.1 * math.sqrt(empty)))
            if more <= spare:
                break
            spare = more
        out.append(Band(len(out), low, high, reach, need - 2 * loose, loose, spare))
        low = high + 1
    return out


def mix(x):
    """A bijective mixing of unsigned 64-bit numbers."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of the `words`-word shingles of the whole text.

    A-Z are lower-cased; words end at space, tab, line feed, vertical tab, form feed and carriage
    return. Fewer words make one shingle, none make no shingle. A word's hash covers its bytes, a
    shingle's its words in order and their number.
    """
    import numpy as np

    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + upper * np.uint8(32)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    # Powers of an odd number go on multiplying modulo 2**64; a prefix sum then gives any word's hash.
    power = np.full(len(low), BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(table[low] * power)))
    back = np.full(int(starts[-1]) + 1, INVERSE, dtype=np.uint64)
    back[0] = 1
    word = mix((total[stops] - total[starts]) * np.multiply.accumulate(back)[starts] + (stops - starts).astype(np.uint64))
    k = min(words, len(word))
    h = np.full(len(word) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(BASE) + word[i:len(word) - k + 1 + i])
    return np.unique(h)


def set_key(s) -> tuple[int, int]:
    """128-bit identity of a set as two longs."""
    import hashlib

    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(s, plan: list[Band], common=None):
    """Hashes under which a set is indexed, over all bands that it takes part in.

    Shingles in the sorted array `common` are left out of the segments: leaving the same shingles out
    of two sets does not enlarge their difference, so the pigeonhole holds for what remains.
    """
    import numpy as np

    n, out = len(s), []
    if common is not None and len(common) and n:
        s = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
    spread = mix(s)
    for b in plan:
        if not b.low <= n <= b.reach:
            continue
        m = b.exact + b.loose
        segment = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        at = segment[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        name = at[first]
        sums = np.add.reduceat(spread[order], first) if len(first) else spread[:0]
        tag = np.uint64((b.number + 1) * BASE & MASK) + name.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(mix(sums + tag))
        if b.loose:
            wide = name >= b.exact
            counts = np.diff(np.append(first, len(s)))
            each, whole, each_tag = np.repeat(wide, counts), np.repeat(sums, counts), np.repeat(tag, counts)
            out.append(mix((whole - spread[order] + each_tag)[each]))
        empty = m - len(name)
        # An empty segment of weight 2 stands for two agreements. Sets with few empty segments have a full one in common.
        weight = empty + int(b.loose - (name >= b.exact).sum())
        if weight > b.spare:
            gone = np.setdiff1d(np.arange(m), name)
            out.append(mix(np.uint64((b.number + 1) * BASE & MASK) + gone.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s) -> bytes:
    """Parities of the numbers of shingles in about as many bins as the set has members (64 to 8192), as bits.

    The number of bins in which two sets differ never exceeds their difference.
    """
    import numpy as np

    bits = min(13, max(6, int(len(s) - 1).bit_length() if len(s) > 1 else 6))
    bins = (mix(s) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bins in which two sketches differ; the finer one is folded to the coarser one's bins."""
    import numpy as np

    if len(a) != len(b):
        fine, coarse = (a, b) if len(a) > len(b) else (b, a)
        x = np.unpackbits(np.frombuffer(fine, dtype=np.uint8))
        while len(x) > 8 * len(coarse):
            x = x[::2] ^ x[1::2]
        a, b = np.packbits(x).tobytes(), coarse
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def identified(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sketch): the size, identity and sketch of every document's set."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, k1, k2, marks = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words)
                a, b = set_key(s)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                marks.append(sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sketch"])
        tidy()

    return _pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


def _pair(docs, id_col, text_col):
    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` whose id may be one of `ids` (doc_id), and the others, which surely are not.

    A bitmap of fixed size tells them apart, so texts that no join needs stay out of its shuffle. With more ids than bits it only keeps out fewer.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED_BITS))
    word, bit = lambda s: F.shiftright(s, 6), lambda s: s.bitwiseAND(F.lit(63)).cast("int")
    bits = ids.select(spot(F.col("doc_id")).alias("s")).groupBy(word(F.col("s")).alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("s")))).alias("__bits"))
    mine = spot(column(docs, id_col).cast("long"))
    hit = F.coalesce(F.getbit("__bits", bit(mine)) == 1, F.lit(False))
    marked = docs.join(F.broadcast(bits), word(mine) == F.col("__word"), "left")
    return marked.where(hit).drop("__word", "__bits"), marked.where(~hit).drop("__word", "__bits")


def common_shingles(docs: DataFrame, documents: int, words: int, id_col: str, text_col: str, sample: int = 16_000, share: float = 0.002):
    """Sorted hashes of shingles that stand in a share of a sample of the documents (eight of them at least).

    Only the plan depends on them: without such shingles fewer unlike documents become candidates, and
    whichever are named, no link is lost. About `sample` documents are drawn by a hash of their
    id, and at most (shingles a document) / share hashes come back, however many documents there are.
    """
    import numpy as np

    drawn = F.pmod(F.xxhash64(column(docs, id_col)), F.lit(1_000_000)) < F.lit(min(1_000_000, int(1_000_000 * sample / max(1, documents)) + 1))

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            for t in batch.column(1):
                held.append(shingle_set(t.as_py(), words))
                n += len(held[-1])
                if n > 2_000_000:
                    h, c = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])
                    held, n = [], 0
        if held:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])
        held = []
        tidy()

    counts = _pair(docs.where(drawn), id_col, text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(8, int(share * min(sample, documents)))).select("h").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def candidate_links(docs: DataFrame, words: int, plan: list[Band], id_col: str, text_col: str, common=None, hashes: int = 0) -> DataFrame:
    """(a, b, star), set keys that stand under one hash.

    Up to FEW keys under a hash come as all their pairs. More come as a star, every key with one of
    them, so a hash gives at most FEW rows a key. A task that holds more than FEW keys of a hash sends on one
    of them and the star of the others, so very frequent hashes reach the shuffle once a task. About `hashes` are expected.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def hashed(batch):
        for doc, t in zip(batch.column(0), batch.column(1)):
            if doc.is_valid:
                s = shingle_set(t.as_py(), words)
                if len(s):
                    yield set_key(s)[0], signatures(s, plan, sent.value)

    return shared_hashes(_pair(docs, id_col, text_col), hashed, hashes)


def shared_hashes(rows: DataFrame, hashed, hashes: int) -> DataFrame:
    """(a, b, star) of keys that share a hash; `hashed` yields (key, its hashes) of a record batch of `rows`, about `hashes` in all.

    Hashes travel packed, from about a million of them a few rows for every reduce task: the differences of the sorted hashes and their keys.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), hashes // TASK_HASHES + 1)
    names = ["task", "gaps", "keys", "many", "star"]
    kinds = "task int, gaps binary, keys binary, many binary, star binary"

    def place(x):
        """The reduce task of a hash: tasks hold ranges of them."""
        import numpy as np

        return ((x >> np.uint64(HASH_BITS - 32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        def pool(sig, key):
            sig, key = _distinct(np.concatenate(sig) >> np.uint64(64 - HASH_BITS), np.concatenate(key))
            first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
            counts = np.diff(np.append(first, len(sig)))
            many = np.repeat(counts > FEW, counts)
            lead = np.repeat(key[first], counts)
            link = many & (key != lead)
            x, y = _distinct(key[link], lead[link])
            to = place(mix(x.view(np.uint64)) >> np.uint64(64 - HASH_BITS))
            order = np.argsort(to, kind="stable")
            star, star_ends = np.stack((x, y), axis=1)[order], np.searchsorted(to[order], np.arange(tasks + 1))
            sig, key, many = sig[~link], key[~link], many[~link]
            ends = np.searchsorted(place(sig), np.arange(tasks + 1))
            out = []
            for k in range(tasks):
                i, j, u, v = ends[k], ends[k + 1], star_ends[k], star_ends[k + 1]
                for a in range(0, max(j - i, v - u), ROW_HASHES):
                    x, y = (slice(min(p + a, q), min(p + a + ROW_HASHES, q)) for p, q in ((i, j), (u, v)))
                    out.append((k, packed_gaps(np.diff(sig[x], prepend=np.uint64(0))), key[x].tobytes(), np.flatnonzero(many[x]).astype("<u4").tobytes(), star[y].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names)

        sig, key, held = [], [], 0
        for batch in batches:
            for k, x in hashed(batch):
                sig.append(x)
                key.append(np.full(len(x), k, dtype=np.int64))
                held += len(x)
                if held > 1_000_000:
                    yield from pool(sig, key)
                    sig, key, held = [], [], 0
        if sig:
            yield from pool(sig, key)
        sig, key = [], []
        tidy()

    def join(batches):
        import numpy as np
        import pyarrow as pa

        def out(a, b, star):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.broadcast_to(star, a.shape))], ["a", "b", "star"])

        def bucket(sig, key, flag):
            """Pairs and stars of whole buckets."""
            first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
            counts = np.diff(np.append(first, len(sig)))
            many = np.repeat((counts > FEW) | np.logical_or.reduceat(flag, first), counts)
            lead = np.repeat(key[first], counts)
            star = many & (key != lead)
            yield _distinct(key[star], lead[star]), True
            few, fk = sig[~many], key[~many]
            for d in range(1, min(FEW, len(few))):
                same = (few[d:] == few[:-d]) & (fk[d:] != fk[:-d])
                if not (few[d:] == few[:-d]).any():
                    break
                yield _distinct(np.maximum(fk[d:][same], fk[:-d][same]), np.minimum(fk[d:][same], fk[:-d][same])), False

        sig, key, flag, links = [], [], [], []
        for batch in batches:
            for gaps, keys, many, star in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                key.append(np.frombuffer(keys, np.int64))
                sig.append(unpacked_gaps(gaps, len(key[-1])))
                flag.append(np.zeros(len(key[-1]), dtype=bool))
                flag[-1][np.frombuffer(many, "<u4")] = True
                links.append(np.frombuffer(star, np.int64).reshape(-1, 2))
        if links:
            x, y = _distinct(*np.concatenate(links).T)
            if len(x):
                yield out(x, y, True)
            sig, key, flag = np.concatenate(sig), np.concatenate(key), np.concatenate(flag)
            order = np.lexsort((key, sig))
            if len(order):
                for (x, y), star in bucket(sig[order], key[order], flag[order]):
                    if len(x):
                        yield out(x, y, star)
        sig = key = flag = links = order = None
        tidy()

    return rows.mapInArrow(emit, kinds).repartitionById(tasks, "task").mapInArrow(join, "a long, b long, star boolean").distinct()


def packed_gaps(gaps) -> bytes:
    """The first gap in eight bytes, the others in four each, or all in eight where one is too long for that."""
    import numpy as np

    if (gaps[1:] >> np.uint64(32)).any():
        return gaps.astype("<u8").tobytes() + b"8"
    return gaps[:1].astype("<u8").tobytes() + gaps[1:].astype("<u4").tobytes() + b"4"


def unpacked_gaps(raw: bytes, n: int):
    """The `n` sorted hashes whose gaps were packed."""
    import numpy as np

    if raw[-1:] == b"8":
        return np.cumsum(np.frombuffer(raw, "<u8", n), dtype=np.uint64)
    gaps = np.concatenate((np.frombuffer(raw, "<u8", min(n, 1)), np.frombuffer(raw[8:-1], "<u4").astype(np.uint64)))
    return np.cumsum(gaps, dtype=np.uint64)


def possible_links(near: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the stars, and those pairs whose sizes and sketches do not rule a link out; `marks` is (k1, n, s), a size and a sketch a key."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = (den - num) * (na + nb) // (den + num)
            fit = num * np.maximum(na, nb) <= den * np.minimum(na, nb)
            differ = [f and sketches_differ(x, y) <= m for f, x, y, m in zip(fit, batch.column(4).to_pylist(), batch.column(5).to_pylist(), most)]
            yield batch.select(["a", "b"]).filter(pa.array([bool(d) for d in differ], pa.bool_()))

    one = marks.select(F.col("k1").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = marks.select(F.col("k1").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    pairs = near.where("not star").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return near.where("star").select("a", "b").unionByName(pairs.mapInArrow(run, "a long, b long"))


def _distinct(a, b):
    import numpy as np

    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[keep], b[keep]


def linked(sets, halves, num: int, den: int):
    """(i, j) pairs that connect all sets with Jaccard >= num / den, in one block (halves None) or between two.

    Postings of the block's shingles give a set's intersections with all others at once. A pair that
    is connected already needs no further link, but every pair is compared.
    """
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, place = np.unique(flat, return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(place))))
    by_place = owner[order]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    root = np.arange(n)
    out = []
    for i in range(n):
        if halves is not None and halves[i]:
            continue
        p = place[bounds[i]:bounds[i + 1]]
        count = starts[p + 1] - starts[p]
        many = count > 1
        begin, count = starts[p][many], count[many]
        if not len(begin):
            continue
        rows = by_place[np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        common = np.bincount(rows, minlength=n)
        close = den * common >= num * (sizes[i] + sizes - common)
        close[i] = False
        if halves is not None:
            close &= halves
        for j in np.flatnonzero(close & (root != root[i])):
            if root[j] != root[i]:
                out.append((i, int(j)))
                a, b = root[i], root[j]
                root[root == max(a, b)] = min(a, b)
    return out


def sizes_in_blocks(members: DataFrame) -> DataFrame:
    """(root, blocks) of the groups of two sets or more."""
    return cut(members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles")).where("sets > 1").select(
        "root", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks")), "jaccard-groups")


def texts_of(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`placed` with the texts of its ids (doc_id)."""
    texts = _pair(split_by_ids(docs, placed, id_col)[0], id_col, text_col)
    return texts.join(placed.hint("shuffle_hash"), "doc_id")


def sets_of(docs: DataFrame, placed: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, root, blocks, block, shingles): the sets of `placed` (doc_id, root, k1, k2, blocks, block), made of their documents' texts again."""
    def again(batches):
        import pyarrow as pa

        for batch in batches:
            ids, roots, k1, k2, blocks, block = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5))
            rows: list = []
            for i, t in enumerate(batch.column(6)):
                s = shingle_set(t.as_py(), words)
                # Another document may bear the same id; only the set in question goes on.
                if set_key(s) == (k1[i], k2[i]):
                    rows.append((ids[i], roots[i], blocks[i], block[i], s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                                 ["doc_id", "root", "blocks", "block", "shingles"])
        tidy()

    joined = texts_of(docs, placed, id_col, text_col).select("doc_id", "root", "k1", "k2", "blocks", "block", "text")
    return joined.mapInArrow(again, "doc_id long, root long, blocks int, block int, shingles binary")


def rare_prefix(s, frequent, times, num: int, den: int):
    """The first shingles of `s` from rare to frequent, so many that any set with Jaccard >= num / den has one of its own first ones among them.

    `frequent` holds sorted hashes, `times` how often each was seen; others count as never seen. Whatever they hold, all sets take their
    shingles in one order, so none of two linked sets can have its common shingles all behind its prefix.
    """
    import numpy as np

    rank = np.zeros(len(s), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rank = np.where(frequent[at] == s, times[at], 0)
    return s[np.lexsort((s, rank))[:len(s) - -(-num * len(s) // den) + 1]]


def regrouped(docs: DataFrame, large: DataFrame, marks: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """`large` (doc_id, k1, k2, n_shingles, root) with its groups cut up into those whose sets hang together by rare shingles; sets alone go.

    Unlike sets that share passages form groups which grow with the corpus, and verifying these whole is quadratic. Linked sets share
    a shingle of their rare prefixes, so they stay together; a set gives a row for about a fifth of its shingles (Jaccard 0.8).
    """
    import numpy as np

    placed = large.select("doc_id", "root", "k1", "k2")
    total = large.agg(F.sum("n_shingles")).first()[0]
    part = min(1_000_000, ORDER_SHINGLES * 1_000_000 // total + 1)

    def own_sets(batch):
        """(root, k1, set) of the rows (root, k1, k2, text) whose text makes the set in question, made here: a second task function would take workers of its own."""
        for root, k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            s = shingle_set(text, words)
            if set_key(s) == (k1, k2):
                yield root, k1, s

    def count(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            for _, _, s in own_sets(batch):
                held.append(s)
                n += len(s)
            if n > 1_000_000:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])
                held, n = [], 0
        if held:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])
        held = []
        tidy()

    # Only the plan depends on the counts: whichever shingles they name, no link is lost.
    drawn = placed.where(F.pmod(F.xxhash64("k2", F.lit(1)), F.lit(1_000_000)) < part)
    names = ["root", "k1", "k2", "text"]
    counts = texts_of(docs, drawn, id_col, text_col).select(*names).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = counts.where("n > 2").toArrow()
    frequent, times = counts.column(0).to_numpy().view(np.uint64), counts.column(1).to_numpy()
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], times[order]))

    def hashed(batch):
        frequent, times = sent.value
        for root, k, s in own_sets(batch):
            own = mix(np.array([root], np.int64).view(np.uint64))
            yield k, mix(rare_prefix(s, frequent, times, num, den) ^ own)

    near = cut(shared_hashes(texts_of(docs, placed, id_col, text_col).select(*names), hashed, total), "jaccard-prefixes")
    groups = components(possible_links(near, marks, num, den))
    return large.drop("root").join(groups, large["k1"] == groups["v"]).select("doc_id", "k1", "k2", "n_shingles", "root")


def verified_links(docs: DataFrame, members: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b), document ids of links that connect every linked pair of a candidate group.

    `members` is (doc_id, k1, k2, n_shingles, root), a document for each set. A group is dealt into blocks; each
    task verifies a block or two blocks against each other, and returns no more links than sets.
    """
    placed = cut(members.join(sizes_in_blocks(members), "root").withColumn("block", F.pmod(F.xxhash64("k2"), F.col("blocks")).cast("int")), "jaccard-members")
    sets = sets_of(docs, placed, words, id_col, text_col)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("doc_id", "root", "block", "shingles", others).select(
        "root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "shingles")

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for (_, x, y), rows in runs(batches, ["root", "x", "y"]):
            if rows.num_rows < 2:
                continue
            ids = rows.column("doc_id").to_pylist()
            sets = [np.frombuffer(b, dtype=np.uint64) for b in rows.column("shingles").to_pylist()]
            halves = None if x == y else rows.column("block").to_numpy() == y
            found = linked(sets, halves, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])
        tidy()

    return dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "doc_id").mapInArrow(verify, "a long, b long")


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text",
    crowd: float = 100.0, alike: float = 0.3,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest id reachable by links of Jaccard >= num / den.

    All words of whole texts count; sets, not multisets. Documents with equal sets are one vertex, so
    copies cost nothing after the first. Documents without words are linked with nothing, not even
    each other; documents with a null id neither, and have component_id null. Rows that repeat an id
    are one document for links: their sets' links join. No rows, no result; other columns are ignored.
    """
    seen = cut(identified(docs, words, id_col, text_col), "jaccard-sets")
    longest, shingles = (x or 0 for x in seen.agg(F.max("n_shingles"), F.sum("n_shingles")).first())
    full = seen.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), "jaccard-classes")
    common = common_shingles(docs, seen.count(), words, id_col, text_col)
    near = cut(candidate_links(docs, words, bands(longest, num, den, crowd, alike), id_col, text_col, common, shingles // 2), "jaccard-candidates")
    marks = cut(full.groupBy("k1").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("s")), "jaccard-sketches")
    groups = components(possible_links(near, marks, num, den))
    members = cut(classes.join(groups, classes["k1"] == groups["v"]).select(
        F.col("rep").alias("doc_id"), "k1", "k2", "n_shingles", "root"), "jaccard-grouped")
    many = sizes_in_blocks(members).where("blocks > 1").select("root")
    large = cut(members.join(many, "root").select(*members.columns), "jaccard-large")
    if large.count():
        again = regrouped(docs, large, marks, words, num, den, id_col, text_col)
        members = cut(members.join(many, "root", "left_anti").unionByName(again), "jaccard-regrouped")
    links = verified_links(docs, members, words, num, den, id_col, text_col)
    # An id with several texts ties its sets together.
    twice = full.groupBy("doc_id", "k1", "k2").agg(F.lit(1).alias("one")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    ties = full.join(twice, "doc_id").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(cut(links.unionByName(ties), "jaccard-links"))
    labels = cut(classes.join(found, classes["rep"] == found["v"], "left").select(
        "k1", "k2", F.coalesce("root", "rep").alias("component_id")), "jaccard-labels")
    # Ids with several texts are one vertex, whatever set a row holds.
    out = seen.drop("sketch").join(labels, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def keep_one_of_group(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those linked to a smaller id, all columns unchanged. Rows with a null id stay, repeated ids together."""
    found = jaccard_components(docs, words, num, den, id_col, text_col)
    gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    some, rest = split_by_ids(docs, gone, id_col)
    gone = gone.select(F.col("doc_id").alias("__gone"))
    return rest.union(some.join(gone.hint("shuffle_hash"), column(some, id_col) == F.col("__gone"), "left_anti"))
