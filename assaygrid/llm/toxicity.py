"""Toxicity by a learnt lexicon whose trie meets Levenshtein automata, with hits weighed by their context."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.common import column, tidy
from assaygrid.llm.mixing import draw
from assaygrid.llm.quality import held_out
from assaygrid.session import cut

log = logging.getLogger(__name__)

# Signs and cues that tell quotation from address.
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term slur phrase insult".split())
ADDRESS = frozenset("you your you're youre u ur yourself".split())
QUOTED, ADDRESSED, WINDOW = 0.3, 1.3, 6
LEET = str.maketrans("013457@$!", "oieastasi")
STEMS = range(4, 9)
# Log likelihood ratios that a word's place in the lexicon takes.
STRONG, WEAK = 14.0, 6.0


def plain(token: str) -> str:
    """A lower-cased token without the punctuation around it; digits and signs inside stand for letters."""
    while token and not token[0].isalnum() and token[0] not in "@$":
        token = token[1:]
    while token and not token[-1].isalnum() and token[-1] != "$":
        token = token[:-1]
    return token if token.isalpha() or token.isdigit() else token.translate(LEET)


class Lexicon:
    """Terms and stems with weights; finds terms within one edit (two from ten letters on, none below four).

    An edit is a letter more, less or other, or two neighbours swapped. While a swap is half read, a state holds what the next
    letter must be and where it leads.

    The Levenshtein automata of all terms run at once over their trie: a state is the set of (trie
    node, edits) that the letters read so far can reach. States are made when first met and
    remembered, so reading a word costs one look-up a letter, and nearly every word dies early.
    """

    def __init__(self, terms: dict, stems: dict, exact_only=frozenset(), remember: int = 30_000):
        self.terms, self.stems, self.exact_only = terms, stems, exact_only
        self.lengths = sorted({len(s) for s in stems})
        self.remember = remember
        self.children: list[dict] = [{}]
        self.term: list = [None]
        self.most = [0]
        for t in terms:
            k = 0 if t in exact_only else self.edits(t)
            if not k:
                continue
            node = 0
            self.most[0] = max(self.most[0], k)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.term[node] = t
        self.forget()

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 10 else 2

    def forget(self):
        self.steps, self.sets, self.numbers = [{}], [{}], {}
        self.start = self.number(self.closed({0: 0}))

    def closed(self, state: dict) -> dict:
        """With the letters that the word may have left out."""
        todo = [(node, e) for node, e in state.items() if not isinstance(node, tuple)]
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < state.get(child, 9):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def number(self, state: dict) -> int:
        """0 is the dead state."""
        if not state:
            return 0
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
        return self.numbers[key]

    def step(self, number: int, letter: str) -> int:
        state: dict = {}
        for node, e in self.sets[number].items():
            if isinstance(node, tuple):
                if node[1] == letter and e < state.get(node[0], 9):
                    state[node[0]] = e
                continue
            if e + 1 <= self.most[node] and e + 1 < state.get(node, 9):
                state[node] = e + 1
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost <= self.most[child] and cost < state.get(child, 9):
                    state[child] = cost
                behind = self.children[child].get(letter)
                if c != letter and behind is not None and e + 1 <= self.most[behind]:
                    swap = behind, c
                    state[swap] = min(e + 1, state.get(swap, 9))
        to = self.number(self.closed(state))
        self.steps[number][letter] = to
        return to

    def near(self, word: str):
        """(edits, term) of the nearest term by edits, then weight, then spelling; None if there is none."""
        if len(self.sets) > self.remember:
            self.forget()
        at = self.start
        for letter in word:
            to = self.steps[at].get(letter)
            at = self.step(at, letter) if to is None else to
            if not at:
                return None
        found = [(e, -self.terms[self.term[n]], self.term[n]) for n, e in self.sets[at].items()
                 if not isinstance(n, tuple) and self.term[n] is not None and e <= self.edits(self.term[n])]
        if not found:
            return None
        e, _, term = min(found)
        return e, term

    def look(self, token: str):
        """(strength, fuzzy term or None) of a token, or None."""
        word = plain(token)
        if not word:
            return None
        if word in self.terms:
            return self.terms[word], None
        best = max((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), default=None)
        if best is not None:
            return best, None
        near = self.near(word)
        return (self.terms[near[1]] / (1 + near[0]), near[1]) if near else None


def hits(lexicon: Lexicon, known: dict, texts: list):
    """Per text: (number of tokens, [(strength in context, fuzzy term or None)]). Null counts as empty.

    A hit between quotation signs, or after a reporting word, within WINDOW tokens counts QUOTED
    times; with the reader addressed nearby it counts ADDRESSED times.
    """
    for text in texts:
        tokens = (text or "").lower().split()
        for t in set(tokens):
            if t not in known:
                known[t] = lexicon.look(t)
        found = []
        for i, t in enumerate(tokens):
            hit = known[t]
            if hit is not None:
                before, after = tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
                opened = any(w[0] in OPENING for w in (*before, t))
                quoted = opened and any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in (t, *after) if w.rstrip(".,;:!?")) or any(
                    plain(w) in REPORTING for w in before)
                factor = QUOTED if quoted else ADDRESSED if any(plain(w) in ADDRESS for w in (*before, *after)) else 1.0
                found.append((hit[0] * factor, hit[1]))
        if len(known) > 150_000:
            known.clear()
        yield len(tokens), found


def _counts(sample: DataFrame) -> DataFrame:
    """(kind, term, toxic documents, other documents): in how many sampled documents a word, or a word beginning, stands."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def flush(counts):
            keys = list(counts)
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
                pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["kind", "term", "toxic", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = {plain(t) for t in set((text.as_py() or "").lower().split())}
                words.discard("")
                counts.update((0, w, toxic) for w in words)
                counts.update((1, s, toxic) for s in {w[:k] for w in words for k in STEMS if len(w) >= k})
                if len(counts) > 300_000:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    return sample.mapInArrow(run, "kind int, term string, toxic int, n long").groupBy("kind", "term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("other"))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, per_class: int, id_col: str, text_col: str):
    """(toxic, text) of about `per_class` labelled documents of each class outside the held-out fold, and the class sizes."""
    known = labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, label_col).alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rate = F.lit(0.0)
    for toxic, n in sizes.items():
        rate = F.when(F.col("toxic") == toxic, F.lit(per_class / n)).otherwise(rate)
    chosen = known.where(draw(F.col("doc_id"), 29) < rate)
    ids = F.broadcast(chosen)  # about 2 * per_class rows of 16 bytes
    own = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return cut(own.join(ids, "doc_id").select("toxic", "text"), "toxicity-sample"), sizes


def _first(rows: DataFrame, most_terms: int | None) -> DataFrame:
    return rows if most_terms is None else rows.limit(2 * most_terms)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2,
          per_class: int = 10_000, most_terms: int | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """(lexicon, weights, bias, sizes) from a sample of about `per_class` labelled documents of each class.

    A word enters when toxic documents hold it at least eight times as often as others and its log
    likelihood ratio against chance is STRONG, or is WEAK and a STRONG beginning of it is known; a
    strong beginning enters itself when it stands for more than its commonest word. Only strong
    words may be misspelt, and only those whose misspellings are as telling in the sample. The evidence of exact and of misspelt hits is then weighed by a
    ridge logistic regression whose rows count as their classes do in the labels. `per_class` bounds the documents learnt
    from, and so what the driver reads: the words and beginnings of the sample that pass these tests, all of them, and two numbers and the
    misspelt terms of each document. `most_terms`, if given, keeps 2 * `most_terms` words and as many beginnings, the most surprising first;
    what it leaves out is logged.
    """
    import numpy as np

    sample, sizes = sampled(docs, labels, label_col, folds, fold, per_class, id_col, text_col)
    there = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = there.get(1, 0), there.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, {}), np.zeros(2), -40.0 if not n1 else 40.0, there
    p = n1 / (n0 + n1)
    ratio = (F.log((F.col("bad") + 0.5) / (n1 + 1.0)) - F.log((F.col("other") + 0.5) / (n0 + 1.0)))
    n, bad, other = F.col("bad") + F.col("other"), F.col("bad"), F.col("other")
    term = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    surprise = term(bad, p) + term(other, 1 - p)
    picked = _counts(sample).where(bad >= 3).select("kind", "term", "bad", ratio.alias("ratio"), surprise.alias("surprise")).where(
        ((F.col("ratio") >= np.log(8.0)) | (F.col("kind") == 1) & (F.col("ratio") > 0)) & (F.col("surprise") >= WEAK))
    picked = cut(picked, "toxicity-terms")
    # Words and beginnings are bounded apart, so that neither crowds the other out.
    rows = [row for kind in (0, 1) for row in _first(picked.where(F.col("kind") == kind).orderBy(F.desc("surprise"), "term"), most_terms).collect()]
    for kind, many in sorted((row[0], row[1]) for row in picked.groupBy("kind").count().collect()):
        if most_terms is not None and many > 2 * most_terms:
            log.warning("toxicity terms: %d %s beyond the bound of %d left out", many - 2 * most_terms, ("words", "beginnings")[kind], 2 * most_terms)
    begins = {r["term"]: r for r in rows if r["kind"] == 1 and r["surprise"] >= STRONG}
    words = {r["term"]: r for r in rows if r["kind"] == 0}
    terms = {w: min(6.0, r["ratio"]) for w, r in words.items()
             if r["surprise"] >= STRONG or any(w[:n] in begins for n in STEMS if n < len(w))}
    commonest: dict = {}
    for w, r in words.items():
        for n in STEMS:
            commonest[w[:n]] = max(commonest.get(w[:n], 0), r["bad"])
    longest: dict = {}
    for s, r in begins.items():
        longest[s[:-1]] = max(longest.get(s[:-1], 0), r["bad"])
    stems = {s: min(6.0, r["ratio"]) for s, r in begins.items() if r["ratio"] >= np.log(8.0)
             and r["bad"] > 1.3 * commonest.get(s, 0) and longest.get(s, 0) < 0.9 * r["bad"]}
    weak = frozenset(w for w in terms if words[w]["surprise"] < STRONG)
    first = Lexicon(terms, stems, weak)

    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            found = list(hits(first, known, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int32()), pa.array([sum(s for s, t in h if t is None) for _, h in found], pa.float64()),
                pa.array([[t for _, t in h if t is not None] for _, h in found], pa.list_(pa.string())),
                pa.array([[s for s, t in h if t is not None] for _, h in found], pa.list_(pa.float64()))], ["toxic", "exact", "near", "strength"])

    seen = sample.mapInArrow(run, "toxic int, exact double, near array<string>, strength array<double>").toArrow().to_pylist()
    met = {}
    for r in seen:
        for t in set(r["near"]):
            met.setdefault(t, [0, 0])[r["toxic"]] += 1
    loose = weak | {t for t, (clean, toxic) in met.items() if (clean + 0.5) / n0 * 8 > (toxic + 0.5) / n1}
    x = np.array([[np.log1p(r["exact"]), np.log1p(sum(s for t, s in zip(r["near"], r["strength"]) if t not in loose))] for r in seen])
    y = np.array([r["toxic"] for r in seen], dtype=np.float64)
    share = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    share *= len(y) / share.sum()
    a = np.column_stack([x, np.ones(len(y))])
    # Prior evidence: a hit of strength e^2 - 1 makes a document likely toxic; the data move it.
    prior, pull = np.array([3.0, 3.0, -3.0]), np.diag([1.0, 1.0, 0.1])
    beta = prior.copy()
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (share * (y - q)) - pull @ (beta - prior)
        move = np.linalg.solve(a.T @ (a * (share * q * (1 - q))[:, None]) + pull, gradient)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return Lexicon(terms, stems, loose), np.maximum(beta[:2], 0.0), float(beta[2]), there


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, hits.

    Every whole text is read once where it lies. Texts without a hit, empty and null ones too, get the
    base score. Repeated ids are scored row by row. Without toxic labels every score is near 0,
    without other labels near 1. No rows, no result; other columns are ignored.
    """
    lexicon, weights, bias, _ = learn(docs, labels, folds=folds, fold=fold, id_col=id_col, text_col=text_col, **options)
    parts = lexicon.terms, lexicon.stems, lexicon.exact_only

    def run(batches):
        import math

        import pyarrow as pa

        own, known = Lexicon(*parts), {}
        for batch in batches:
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 256):
                scores, numbers = [], []
                for _, found in hits(own, known, texts.slice(i, 256).to_pylist()):
                    exact = sum(s for s, t in found if t is None)
                    near = sum(s for s, t in found if t is not None)
                    z = bias + weights[0] * math.log1p(exact) + weights[1] * math.log1p(near)
                    scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
                    numbers.append(len(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())],
                                                 ["doc_id", "score", "hits"])
        del own
        known.clear()
        tidy()

    pair = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    out = pair.mapInArrow(run, "doc_id long, score double, hits long")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
