"""Exact top-k by inner product over an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaygrid.llm.common import column
from assaygrid.session import cut

LEVELS = 32
ROWS = 4096
# Scaled components beyond this count as this; scores beyond a long as the nearest long.
WIDEST = (1 << 62) - 1


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * component) as whole numbers.

    Rows with a null id, a null vector, or a component that is null or not finite take no part. Components are whole numbers of 64 bits,
    saturated at 2**62 - 1 in size.
    """
    whole = lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))
    bound = F.lit(WIDEST)
    big = lambda e: F.lit(float(scale)) * e.cast("double")
    x = F.transform(column(vectors, vector_col), lambda e: F.when(big(e) >= float(WIDEST), bound).when(big(e) <= -float(WIDEST), -bound).otherwise(whole(e)))
    fine = F.forall(column(vectors, vector_col), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), F.when(fine, x).alias("v")).where("vec_id is not null and v is not null")


def build_index(rows: DataFrame) -> DataFrame:
    """The index as a table of blocks of up to ROWS vectors: (ids, width, codes, order, bounds).

    In a block every dimension's postings stand in the order of their component, and `bounds` cuts
    that order into LEVELS segments of equal value range. Every row is in exactly one block. Short
    vectors count as padded with zeros, which leaves inner products as they are.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(ids, vectors):
            width = max((len(v) for v in vectors), default=0)
            x = np.zeros((len(vectors), width), dtype=np.int64)
            for i, v in enumerate(vectors):
                x[i, :len(v)] = v
            order = np.argsort(x, axis=0, kind="stable").astype(np.uint16).T
            low, high = x.min(axis=0, initial=WIDEST), x.max(axis=0, initial=-WIDEST)
            # Edges of the value segments; the first is below every value, the last above. Python's numbers, for products may pass 64 bits.
            edges = np.array([[a + (b + 1 - a) * i // LEVELS for a, b in zip(low.tolist(), high.tolist())] for i in range(LEVELS + 1)],
                             dtype=np.int64).reshape(LEVELS + 1, width)
            bounds = np.array([np.searchsorted(x[order[d], d], edges[:, d]) for d in range(width)], dtype=np.int32)
            return pa.RecordBatch.from_pydict({
                "ids": [np.asarray(ids, dtype=np.int64).tobytes()], "width": [width], "codes": [x.tobytes()],
                "postings": [np.ascontiguousarray(order).tobytes()], "bounds": [bounds.tobytes()], "edges": [edges.T.astype(np.int64).tobytes()],
            }, schema=pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("codes", pa.binary()), ("postings", pa.binary()),
                                 ("bounds", pa.binary()), ("edges", pa.binary())]))

        ids, vectors = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += [np.asarray(v, dtype=np.int64) for v in batch.column(1).to_pylist()]
            while len(ids) >= ROWS:
                yield block(ids[:ROWS], vectors[:ROWS])
                ids, vectors = ids[ROWS:], vectors[ROWS:]
        if ids:
            yield block(ids, vectors)

    return rows.mapInArrow(run, "ids binary, width int, codes binary, postings binary, bounds binary, edges binary")


class Block:
    """One block of the index, read."""

    def __init__(self, row: dict):
        import numpy as np

        self.np, self.width = np, row["width"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        n = len(self.ids)
        self.codes = np.frombuffer(row["codes"], dtype=np.int64).reshape(n, self.width)
        self.postings = np.frombuffer(row["postings"], dtype=np.uint16).astype(np.int64)
        bounds = np.frombuffer(row["bounds"], dtype=np.int32).reshape(self.width, LEVELS + 1)
        self.counts = np.diff(bounds, axis=1)
        edges = np.frombuffer(row["edges"], dtype=np.int64).reshape(self.width, LEVELS + 1)
        self.low, self.high = edges[:, 0], edges[:, -1] - 1
        self.left, self.right = edges[:, :-1], np.minimum(np.maximum(edges[:, 1:] - 1, edges[:, :-1]), self.high[:, None])

    def top(self, q, own: int, k: int, known=None):
        """Exact top k of the block for query q: (scores, ids), best first, ties to the smaller id.

        A component's gain is what it adds above the least that any row of the block gets from its
        dimension. A segment's impact is the least gain of its rows, and segments are taken by falling
        impact, in four rounds. A row's sum of impacts so far is a lower bound of its gains; the sum over
        dimensions of the larger of a segment's spread and the best gain still open bounds what
        it may miss. A row that cannot reach the k-th best lower bound, nor `known`, the k-th best score
        that the caller already has, is no member. Rounds end early only when that leaves few rows;
        those are scored exactly.
        """
        np = self.np
        n = len(self.ids)
        if not n:
            return np.zeros(0, np.int64), self.ids
        q = np.concatenate([q[:self.width], np.zeros(max(0, self.width - len(q)), np.int64)])
        # Impacts are doubles; `noise` is more than their sums can be off by.
        up, size = (q > 0)[:, None], np.abs(q).astype(float)[:, None]
        reach_all = float((size[:, 0] * np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))).sum())
        noise = 1e-11 * (reach_all + abs(float(known or 0))) + 1
        impact = size * np.where(up, self.left - self.low[:, None], self.high[:, None] - self.right)
        best = size * np.where(up, self.right - self.low[:, None], self.high[:, None] - self.left)
        spread = (best - impact).max(axis=1, initial=0)
        floor = None if known is None else float(known) - float((q.astype(float) * np.where(up[:, 0], self.low, self.high)).sum())
        live = np.broadcast_to(size > 0, impact.shape)
        done = np.zeros(impact.shape, dtype=bool)
        rank = np.argsort(-impact, axis=None, kind="stable")
        filled = np.cumsum(self.counts.ravel()[rank])
        mine = self.ids == own
        acc, keep = np.zeros(n), np.arange(n)
        for part in (0.6, 0.8, 0.92, 1.0):
            limit = impact.ravel()[rank[min(np.searchsorted(filled, part * filled[-1]), len(rank) - 1)]] if len(rank) and part < 1 else 0
            now = (impact >= limit) & ~done & live
            done |= now
            counts = self.counts[now]
            if counts.sum():
                rows = self.postings[np.repeat(now.ravel(), self.counts.ravel())]
                # Sums of whole numbers in doubles; `slack` makes up for rounding beyond 2**53.
                acc += np.bincount(rows, weights=np.repeat(impact[now], counts), minlength=n)
            rest = np.where(done, 0, best).max(axis=1, initial=0)
            slack = float(np.maximum(spread, rest).sum()) * (1 + 1e-9) + noise
            others = acc[~mine]
            reach = -np.inf if floor is None else floor
            if len(others) > k:
                reach = max(reach, np.partition(others, len(others) - k)[len(others) - k])
            keep = np.flatnonzero(acc + slack >= reach - noise)
            if len(keep) <= n // 16:
                break
        keep = keep[~mine[keep]]
        score = self.codes[keep] @ q
        if reach_all >= 1 << 62:
            # Sums of 64 bits wrap around; those near or past the end of a long are taken in Python's numbers and saturated.
            rough = self.codes[keep].astype(float) @ q.astype(float)
            for i in np.flatnonzero(np.abs(rough) >= 1 << 62):
                score[i] = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(self.codes[keep[i]].tolist(), q.tolist()))))
        pick = np.lexsort((self.ids[keep], -score))[:k]
        return score[pick], self.ids[keep[pick]]


def top_k(queries: DataFrame, index: DataFrame, k: int = 10, chunk: int = 100_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of the index, but for rows of its own id.

    `queries` is (vec_id, v), distinct rows; `index` comes from `build_index` and is best read from
    a table. The queries go out in chunks of at most `chunk`, the size bound of a broadcast (51 MB at
    64 components), and each chunk runs over all blocks. A task keeps k rows per query over its
    blocks, so the merge reads k rows for each query and task. Fewer candidates give fewer ranks; repeated ids
    are candidates of their own.
    """
    spark = index.sparkSession
    n = queries.count()
    parts = max(1, -(-n // chunk))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))) if parts > 1 else queries.withColumn("part", F.lit(0))
    found = None
    for part in range(parts):
        table = dealt.where(F.col("part") == part).select("vec_id", "v").toArrow()
        sent = spark.sparkContext.broadcast(_matrix(table))
        some = index.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        found = some if found is None else found.unionByName(some)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(table):
    """(ids, vectors padded to one width) of an Arrow table."""
    import numpy as np

    vectors = table.column(1).to_pylist()
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return table.column(0).to_numpy(), out


def _search(sent, k):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        own, vectors = sent.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for i, (o, q) in enumerate(zip(own, vectors)):
                    have = int(best[i][0][-1]) if i in best and len(best[i][0]) == k else None
                    score, ids = block.top(q.astype(np.int64), o, k, have)
                    if i in best:
                        score, ids = np.concatenate([best[i][0], score]), np.concatenate([best[i][1], ids])
                        pick = np.lexsort((ids, -score))[:k]
                        score, ids = score[pick], ids[pick]
                    best[i] = score, ids
        if best:
            sizes = [len(best[i][1]) for i in best]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(own[list(best)], sizes)),
                pa.array(np.concatenate([best[i][1] for i in best])), pa.array(np.concatenate([best[i][0] for i in best])),
            ], ["query_id", "vec_id", "score"])

    return run


def search_table(vectors: DataFrame, is_query, k: int = 10, **columns) -> DataFrame:
    """Index every row of `vectors`, search with the rows that satisfy `is_query` (a condition on vec_id).

    A query id with several different vectors searches with each, and the hits share one ranking: a row that several of them find counts once for
    each. Equal rows search once.
    """
    rows = scaled(vectors, **columns)
    index = cut(build_index(rows), "impact-index")
    queries = rows.where(is_query).distinct()
    return top_k(queries, index, k)
