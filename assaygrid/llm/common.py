"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df[f"`{name}`"]


def runs(batches, keys: list[str], whole: bool = True):
    """Arrow tables of one key each, from batches that arrive sorted by `keys`.

    Only the rows of the current key are held, so a caller bounds memory by bounding a key's rows. Without `whole` a key's rows
    come in pieces as they arrive and nothing is held.
    """
    import numpy as np
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(n, dtype=bool)
        edge[0] = True
        for c in cols:
            edge[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(edge)
        for i, start in enumerate(starts):
            stop = starts[i + 1] if i + 1 < len(starts) else n
            key = tuple(c[start] for c in cols)
            if not whole:
                yield key, pa.Table.from_batches([batch.slice(start, stop - start)])
                continue
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield last, pa.Table.from_batches(held)


def tidy():
    """Give memory that a task's arrays took back to the system, for its worker process goes on with tasks of other stages."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc: nothing to trim


def one_thread():
    """Let numpy multiply matrices on one thread in this process: every core has a task of its own, and small products only wait for each other."""
    import ctypes

    import numpy  # noqa: F401  (loads the library that is looked for)

    try:
        paths = {line.split()[-1] for line in open("/proc/self/maps") if "blas" in line and line.rstrip().split(".so")[0] != line.rstrip()}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
