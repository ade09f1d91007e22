"""Runs of repeated words in texts: a suffix automaton whose suffix-link tree is accessed as a link-cut tree.

Appending word i accesses the path from the root of the suffix-link tree to the state of prefix i. The path falls into
segments, each with one last-occurrence end c; the deepest state of a segment gives the length L of the longest
suffix that occurred there last. The suffix then repeats at the distance i - c: where that is at most L, it is a
square, and the stretch of L + (i - c) words has this period. The access recolours the whole path with i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from assaygrid.llm.common import column, tidy
from assaygrid.llm.words import slices, sums_by_text, take_runs, word_codes

RUN = "array<struct<start: long, length: long, period: long>>"


def automaton(words: list[int]):
    """(length, link, states): the suffix automaton of a sequence, and the state of each prefix."""
    length, link, follow, states = [0], [-1], [{}], []
    last = 0
    for w in words:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        follow.append({})
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = now
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                while p >= 0 and follow[p].get(w) == q:
                    follow[p][w] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
        states.append(now)
    return length, link, states


def runs_of(words: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch of length >= max(least, exponent * period), by start, then period.

    The period is a stretch's smallest. Needs exponent >= 3. Time is O(n log n).
    """
    length, link, states = automaton(words)
    n = len(length) + 1
    # Splay trees hold the segments, deeper states to the right; node = state + 1, 0 is none. `up` of a tree's root is
    # the state above its segment; `last` of a tree's root is the segment's last occurrence.
    up = [0] + [p + 1 for p in link]
    left, right, last = [0] * n, [0] * n, [0] * n
    depth = [0] + length
    found: dict[tuple[int, int], int] = {}
    for i, s in enumerate(states, 1):
        below, x = 0, s + 1
        while x:
            # Splay x to the root of its tree.
            p = up[x]
            while p and (left[p] == x or right[p] == x):
                g = up[p]
                x_left = left[p] == x
                if g and (left[g] == p or right[g] == p):
                    top = up[g]
                    if x_left:
                        if left[g] == p:
                            b, c = right[p], right[x]
                            left[g], right[p], left[p], right[x] = b, g, c, p
                            if b:
                                up[b] = g
                            if c:
                                up[c] = p
                            up[g], up[p] = p, x
                        else:
                            b, c = left[x], right[x]
                            right[g], left[p], left[x], right[x] = b, c, g, p
                            if b:
                                up[b] = g
                            if c:
                                up[c] = p
                            up[g] = up[p] = x
                    elif right[g] == p:
                        b, c = left[p], left[x]
                        right[g], left[p], right[p], left[x] = b, g, c, p
                        if b:
                            up[b] = g
                        if c:
                            up[c] = p
                        up[g], up[p] = p, x
                    else:
                        b, c = right[x], left[x]
                        left[g], right[p], right[x], left[x] = b, c, g, p
                        if b:
                            up[b] = g
                        if c:
                            up[c] = p
                        up[g] = up[p] = x
                    up[x] = top
                    last[x] = last[g]
                    if top:
                        if left[top] == g:
                            left[top] = x
                        elif right[top] == g:
                            right[top] = x
                    p = top
                else:
                    if x_left:
                        c = right[x]
                        left[p], right[x] = c, p
                    else:
                        c = left[x]
                        right[p], left[x] = c, p
                    if c:
                        up[c] = p
                    up[p], up[x] = x, g
                    last[x] = last[p]
                    break
            seen = last[x]
            if seen:
                d, most = i - seen, depth[x]
                if most >= (exponent - 1) * d and most + d >= least:
                    found[i - most - d, d] = i
            # What lies below x keeps its colour as a segment of its own.
            if right[x]:
                last[right[x]] = seen
            right[x] = below
            below, x = x, up[x]
        last[below] = i
    return sorted((start, stop - start, d) for (start, d), stop in found.items())


def stretches(codes, counts, least: int, exponent: int):
    """(text, first, stop) of stretches of a batch's words that can hold runs, as arrays.

    In a run of least >= 6 words and exponent >= 4 each three words in a row stand at least three times. Threes are counted by hash
    within their text, so counts are never too small, and every run lies whole in a stretch of threes counted three times.
    """
    import numpy as np

    n = len(codes)
    text = np.repeat(np.arange(len(counts)), counts)
    if n < 6:
        return text[:0], text[:0], text[:0]
    key = codes.astype(np.uint64) + np.uint64(1)
    h = key[:-2] * np.uint64(0x9E3779B97F4A7C15)
    for part in (key[1:-1], key[2:], text[2:].astype(np.uint64)):
        h = (h ^ (h >> np.uint64(29)) ^ part) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    slots = max(10, int(n * 3).bit_length())
    h = (h >> np.uint64(64 - slots)).astype(np.int64)
    inside = text[:-2] == text[2:]
    many = np.bincount(h[inside], minlength=1 << slots) >= 3
    good = np.concatenate(([False], many[h] & inside, [False])).astype(np.int8)
    edge = np.diff(good)
    # Threes of one text only are neighbours: the last two words of a text begin none.
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stop - first >= 4
    first, stop = first[long], stop[long] + 2
    return text[first], first, stop


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4,
) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period, by start then period), and the text without repeats.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0; null text has none. A run is a stretch of words of smallest
    period q and length >= max(least, exponent * q) that no neighbour extends; a word leaves the text if a run holds it after
    the run's first q words, kept words are joined by one space. least >= 6 and exponent >= 4. A text is worked on
    in one task, memory grows with its longest stretch that can hold runs. Rows are independent: repeated and null
    ids stay, other columns are ignored, no rows give no rows.
    """
    if least < 6 or exponent < 4:
        raise ValueError("runs of fewer than 6 words or 4 periods are not found")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        spans = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in slices(batches, most=4 << 20):
            codes, counts, distinct = word_codes(batch.column(1))
            begin = np.cumsum(counts) - counts
            rows, keep = [[] for _ in counts], np.ones(len(codes), dtype=bool)
            for t, first, stop in zip(*(a.tolist() for a in stretches(codes, counts, least, exponent))):
                for start, length, period in runs_of(codes[first:stop].tolist(), least, exponent):
                    rows[t].append({"start": first + start - int(begin[t]), "length": length, "period": period})
                    keep[first + start + period:first + start + length] = False
            kept = sums_by_text(keep.astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans), joined(codes[keep], kept, distinct)], ["doc_id", "runs", "collapsed"])
        tidy()

    pair = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return pair.mapInArrow(run, f"doc_id long, runs {RUN}, collapsed string")


def joined(codes, counts, distinct):
    """Arrow texts of `counts` words each, joined by one space."""
    import numpy as np
    import pyarrow as pa

    bounds = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
    raw = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8)
    at, each = take_runs(np.diff(bounds), codes, bounds[:-1])
    # A space behind every word but a text's last one.
    ends = np.cumsum(counts)
    gap = np.ones(len(codes), dtype=np.int64)
    gap[ends[counts > 0] - 1] = 0
    size = each + gap
    out = np.full(int(size.sum()), 32, dtype=np.uint8)
    where = np.arange(len(at)) + np.repeat(np.cumsum(gap) - gap, each)
    out[where] = raw[at]
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    offsets = np.concatenate((np.zeros(1, np.int64), total[ends])).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(out))
