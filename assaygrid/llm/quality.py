"""Quality by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.common import column
from assaygrid.session import cut

NAMES = ("words", "word_length", "distinct", "repeats", "longest_run", "top_word", "upper", "digits", "bars", "shouts",
         "symbols", "stops", "commas", "line_length", "repeated_lines")
LIKE = 20


def statistics(texts: list) -> list[list[float]]:
    """Transformed statistics of whole texts: logs of sizes, square roots of shares. Null counts as empty.

    A share is taken as if LIKE further words (or lines, or letters) of ordinary prose stood in the
    text, so that a few words are not judged by chance counts.
    """
    import math
    from collections import Counter

    import numpy as np

    symbols = np.frombuffer(b"#$%&*@^~`=+<>{}[]\\_/", dtype=np.uint8)
    out = []
    for text in texts:
        text = text or ""
        words = text.split()
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        share = lambda x, of, usual=0.0, like=LIKE: math.sqrt((x + like * usual) / (of + like))
        counts = Counter(words)
        run = longest = repeats = 0
        last = None
        for w in words:
            if w == last:
                repeats += 1
                run += 1
                if run > longest:
                    longest = run
            else:
                run, last = 0, w
        upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
        chars = max(1, len(text))
        out.append([
            math.log1p(n), math.log1p((len(text) + 6 * LIKE) / (n + LIKE)), share(len(counts), n, 0.8), share(repeats, n), math.log1p(longest),
            share(max(counts.values(), default=0), n, 0.06), share(upper, upper + lower, 0.03, 5 * LIKE),
            share(int(byte[48:58].sum()), chars, 0.0, 5 * LIKE), share(int(byte[124]), n), share(int(byte[33]), n), share(int(byte[symbols].sum()), n),
            share(int(byte[46]), n, 0.1), share(int(byte[44]), n, 0.04), math.log1p((chars + 5 * LIKE) / (len(lines) + 1)),
            share(len(lines) - len(set(lines)), len(lines), 0.0, 5),
        ])
    return out


@dataclass
class Quadratic:
    """Two Gaussian classes: log priors, means, and the inverse Cholesky factors and log determinants kept from the fit.

    Without rows of both classes every score is `constant`.
    """

    priors: list
    means: list
    factors: list
    logdets: list
    constant: float | None = None

    def scores(self, rows: list):
        import numpy as np

        if self.constant is not None:
            return np.full(len(rows), self.constant)
        x = np.asarray(rows, dtype=np.float64).reshape(len(rows), len(NAMES))
        density = [p - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
                   for p, m, f, d in zip(self.priors, self.means, self.factors, self.logdets)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every document, one pass over the texts."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 256):
                x = statistics(texts.slice(i, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    pair = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return pair.mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id, folds: int, fold: int):
    """Is the row kept from learning: crc32 of the id as text, null as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1,
        toward_pooled: float = 0.2, toward_diagonal: float = 0.1, ridge: float = 1e-3) -> Quadratic:
    """Fit on every labelled row outside the held-out fold.

    Class counts, sums and cross products are one aggregate over the joined statistics; the driver
    gets two rows of numbers. A class covariance is drawn `toward_pooled` to the common one, then
    `toward_diagonal` to its own diagonal, and gets `ridge` on the diagonal. Labels that are null are
    left out; a repeated label counts as often as it stands.
    """
    import numpy as np

    known = labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, label_col).alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    rows = {r["label"]: r for r in found.join(known, "doc_id").groupBy("label").agg(
        F.count("*").alias("n"), F.array(*sums).alias("s")).collect()}
    if len(rows) < 2:
        return Quadratic([], [], [], [], constant=float(next(iter(rows))) if rows else 0.5)
    counts, means, spreads = [], [], []
    for label in (0, 1):
        n, s = rows[label]["n"], np.array(rows[label]["s"])
        mean, cross = s[:d] / n, np.zeros((d, d))
        for (i, j), v in zip(pairs, s[d:]):
            cross[i, j] = cross[j, i] = v
        counts.append(n)
        means.append(mean)
        spreads.append(cross / n - np.outer(mean, mean))
    total = sum(counts)
    pooled = sum(n * c for n, c in zip(counts, spreads)) / total
    factors, logdets = [], []
    for c in spreads:
        c = (1 - toward_pooled) * c + toward_pooled * pooled
        c = (1 - toward_diagonal) * c + toward_diagonal * np.diag(np.diag(c)) + ridge * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Quadratic([np.log(n / total) for n in counts], means, factors, logdets)


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.5, **columns) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is the posterior of label 1, from text alone. Empty and null texts have statistics of
    zero and are scored like others. The statistics of all documents are written once and read for
    the fit and for the scores, so texts are read once and never shuffled. Repeated ids are scored
    row by row; without labels every score is 0.5, with one class that class. No rows, no result.
    """
    found = cut(features(docs, **columns), "quality-statistics")
    model = fit(found, labels, folds=folds, fold=fold)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    out = found.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents whose score reaches `threshold`, all columns unchanged; scored where they are read."""
    model = fit(cut(features(docs, id_col, text_col), "quality-statistics"), labels)
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                good = model.scores(statistics(some.column(place).to_pylist())) >= threshold
                yield some.filter(pa.array(good))

    # Plain names on the way: a dotted one could not be passed to the task.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
