"""Sum-of-squares packing of token sequences into windows of a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assaygrid.llm.common import column, tidy
from assaygrid.llm.words import WordIds, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenizer(path: str):
    """One per worker process, so tasks that follow each other share the remembered words."""
    import sys

    kept = sys.modules.setdefault("_pack_tokenizers", {})
    if path not in kept:
        kept.clear()
        kept[path] = WordIds(path, 250_000)
    return kept[path]


class Levels:
    """Windows that are partly filled, by fill level: `count[h]` of them hold h ids."""

    def __init__(self, size: int):
        import numpy as np

        self.size, self.np = size, np
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list] = {}
        self.held = 0

    def place(self, piece) -> list | None:
        """Put a piece (doc, start, ids, total) where the squared counts grow least; a full window comes back.

        Opening a window raises count[s]; a window at level h leaves count[h] and, unless it is then
        full, enters count[h + s]. Of equal choices the fullest window is taken, so nothing is
        opened needlessly.
        """
        s = len(piece[2]) // 4
        if s == self.size:
            return [piece]
        c = self.count
        last = self.size - s
        grow = 1 - 2 * c[1:last + 1]
        grow[:-1] += 1 + 2 * c[s + 1:self.size]
        grow[c[1:last + 1] == 0] = self.np.iinfo(self.np.int64).max
        level = 0
        if last:
            best = last - int(self.np.argmin(grow[::-1]))
            if grow[best - 1] <= 2 * c[s] + 1:
                level = best
        self.held += s
        if not level:
            self.open.setdefault(s, []).append([piece])
            c[s] += 1
            return None
        window = self.open[level].pop()
        c[level] -= 1
        window.append(piece)
        if level + s == self.size:
            self.held -= self.size
            return window
        self.open.setdefault(level + s, []).append(window)
        c[level + s] += 1
        return None

    def close(self) -> list[list]:
        """The open windows made full: the emptiest are taken apart and cut to fill the fullest.

        What is left fills less than one window; it is cut into windows of a power of two each.
        """
        windows = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.held = {}, 0
        self.count[:] = 0
        done, i, j, spare = [], 0, len(windows) - 1, []
        while i <= j:
            room, window = self.size - windows[i][0], windows[i][1]
            while room and (spare or j > i):
                if not spare:
                    spare = windows[j][1][::-1]
                    j -= 1
                piece = spare.pop()
                head, rest = cut_piece(piece, room)
                window.append(head)
                room -= len(head[2]) // 4
                if rest:
                    spare.append(rest)
            if room:
                spare = window[::-1]
            else:
                done.append(window)
            i += 1
        left = sum(len(p[2]) // 4 for p in spare)
        while left:
            room, window = 1 << (min(left, self.size).bit_length() - 1), []
            left -= room
            while room:
                head, rest = cut_piece(spare.pop(), room)
                window.append(head)
                room -= len(head[2]) // 4
                if rest:
                    spare.append(rest)
            done.append(window)
        return done


def cut_piece(piece, room: int):
    doc, start, ids, total = piece
    if len(ids) <= 4 * room:
        return piece, None
    return (doc, start, ids[:4 * room], total), (doc, start + room, ids[4 * room:], total)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    size: int = 4096, end: int = 2, hold: int = 4_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every document is tokenised whole and ends with the id `end`; null text counts as empty. Whole
    windows are cut off long documents; the rest of each goes online to the fill level that keeps
    the sum of squared counts of partly filled windows smallest. Each input partition packs its own
    rows in one pass, without a shuffle, and closes its windows at its end, or sooner when they hold
    over `hold` ids, which bounds memory. Closing cuts documents so that windows are full, but for
    fewer than log2(size) windows of a power of two each. Sequence ids hold the partition number
    above 40 bits. Null and repeated ids are packed like others. No rows, no pieces.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tok, levels, number = tokenizer(tokenizer_path), Levels(size), TaskContext.get().partitionId() << 40
        close = end.to_bytes(4, "little")
        out: list = [[] for _ in range(7)]
        weight = 0

        def emit(window):
            nonlocal number, weight
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                for col, v in zip(out, (doc, start, n, ids, total, number, at)):
                    col.append(v)
                at += n
            weight += at
            number += 1

        def flush():
            nonlocal weight
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(out)], names)
            for c in out:
                c.clear()
            weight = 0
            return batch

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in slices(batches):
            flat, counts = tok.encode(batch.column(1))
            flat, at = flat.astype("<u4").tobytes(), 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                data = flat[4 * at:4 * (at + n)] + close
                at += n
                for start in range(0, n + 1, size):
                    full = levels.place((doc, start, data[4 * start:4 * (start + size)], n + 1))
                    if full:
                        emit(full)
                    if levels.held > hold:
                        for window in levels.close():
                            emit(window)
                    if weight > 1 << 20:
                        yield flush()
        for window in levels.close():
            emit(window)
            if weight > 1 << 20:
                yield flush()
        if out[0]:
            yield flush()
        tidy()

    pair = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return pair.mapInArrow(run, SCHEMA)

