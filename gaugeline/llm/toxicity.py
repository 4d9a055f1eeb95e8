"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Examples are at most ``MAX_EXAMPLES`` labelled documents of each class (those with the smallest id
hash). Every word of the examples is a term. Words and word beginnings whose share of documents differs
between the classes by more chi-square than the best of as many chance terms would show are telling: they
weigh ``TELLING`` times as much, and telling beginnings are terms too. A document counts for that only where
it brings a new context (the neighbouring words), which keeps copies of one text from passing for evidence.
Document frequencies are counted over all documents.

The index cuts the examples into blocks and keeps, for each term, every block's largest weight. A
query's sum of those is a bound on its cosine with anything in the block; the blocks with the largest
bounds are opened first, then each one whose bound reaches the k-th cosine found, so the k nearest are
exact, equal cosines going to the smaller example id. Votes are weighted by closeness, and isotonic
regression over the examples' own leave-one-out votes turns them into calibrated scores.

Defined cases: null text scores as the empty text; a text without any word of any example gets the
share of toxic ones among such examples; words that no example holds have no part in a cosine;
conflicting or null labels do not train; repeated rows each get a row; of examples with equal cosines those
with the smaller ids vote; without both labels every score is the share of label 1 (0.5 without labels);
texts of any length count whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import bounded_batches, fresh, hand_back, handing_back, held_out, read
from gaugeline.llm.quality import sample_ids

#: Bound of the examples of each class, whatever the size of the labels table.
MAX_EXAMPLES = 2_500
#: How many times a telling term weighs what its frequency gives it.
TELLING = 10.0
MIN_DOCS = 4
#: Lengths in bytes of the word beginnings that are terms too (compounds share a beginning).
PREFIXES = (5, 6, 7, 8, 9)
NEIGHBOURS = 15
BLOCK = 64
#: Terms that this share of the examples hold are stored as rows, the others as postings.
ROW_SHARE = 1 / 20
#: Texts whose scores and evidence a task holds as objects.
PIECE = 512
#: Texts searched together, and postings that they meet at most, unless one text alone meets more.
TOGETHER = 64
SPREAD = 1_000_000
THRESHOLD = 0.5
_EPS = 0.05

_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, non-ASCII characters included."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings (marked with a star) of a few lengths in bytes."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def _chi2(a: int, n: int, share: float) -> float:
    return (a - n * share) ** 2 / (n * share * (1 - share))


def select_terms(texts: list[str], y: np.ndarray) -> list[bytes]:
    """The terms that tell the classes apart, strongest first, by the documents that hold them.

    A first count takes every document; for the terms that pass it, a second one takes a document
    only if it holds the term in a context (the words on both sides) that no earlier example of the
    class had, so copies of a text, near or exact, count about once.
    """
    share = max(1, int((np.asarray(y) == 1).sum())) / max(2, len(y))
    plain: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, y, strict=True):
        plain[int(label)].update({t for w in set(words_of(text)) for t in terms_of(w)})
    least = 2 * np.log(max(2, len(plain[0]) + sum(t not in plain[0] for t in plain[1]))) + 2
    strong = {t for t, a in plain[1].items() if a + plain[0][t] >= MIN_DOCS and _chi2(a, a + plain[0][t], share) >= least}
    strong |= {t for t, b in plain[0].items() if b >= MIN_DOCS and t not in plain[1] and _chi2(0, b, share) >= least}
    del plain  # its terms are many times those that stay
    seen: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    support: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, y, strict=True):
        w, label = words_of(text), int(label)
        met, new = seen[label], set()
        for before, word, after in zip([b"", *w[:-1]], w, [*w[1:], b""], strict=True):
            if found := strong.intersection(terms_of(word)):
                context = before + b" " + after  # words hold no space
                for t in found:
                    if context not in met[t]:
                        met[t].add(context)
                        new.add(t)
        support[label].update(new)
    found = []
    for t in strong:
        a, n = support[1][t], support[0][t] + support[1][t]
        if n >= MIN_DOCS and (chi2 := _chi2(a, n, share)) >= least:
            found.append((-chi2, t))
    return [t for _, t in sorted(found)]


def all_terms(texts: list[str], telling: list[bytes]) -> list[bytes]:
    """The telling terms, then every other word of the texts, those in most texts first."""
    held = Counter(w for text in texts for w in set(words_of(text)))
    known = set(telling)
    return [*telling, *sorted((w for w in held if w not in known), key=lambda w: (-held[w], w))]


class Vocabulary:
    """Numbers of the terms in a text, telling terms first."""

    def __init__(self, terms: list[bytes], telling: int = 0) -> None:
        self.number = {t: i for i, t in enumerate(terms)}
        self.telling = telling
        # most words share no head with a telling beginning, so their beginnings need not be made
        self.heads = {t[: PREFIXES[0]] for t in terms[:telling] if t.endswith(b"*")}

    def __len__(self) -> int:
        return len(self.number)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "number": b" ".join(self.number)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, number={t: i for i, t in enumerate(state["number"].split())})

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Rows (term number, count) of the terms in a text."""
        number, held = self.number, Counter(words)
        out = {t: n for t, n in zip(map(number.get, held), held.values(), strict=True) if t is not None}
        head, heads = PREFIXES[0], self.heads
        for w in [w for w in held if w[:head] in heads]:
            for b in terms_of(w)[1:]:
                if (t := number.get(b)) is not None:
                    out[t] = out.get(t, 0) + held[w]
        return np.array(list(out.items()), np.int32).reshape(-1, 2)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of the ranges, one range after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples in blocks, each with its terms' largest weights.

    ``idf`` may hold more than the frequencies give: it is the weight of a term that occurs once.
    """

    def __init__(self, idf: np.ndarray, counts: list, ids: list[int], y: np.ndarray, weight: np.ndarray, block: int = BLOCK) -> None:
        self.idf = np.asarray(idf, float)
        counts = [np.asarray(c, np.int32).reshape(-1, 2) for c in counts]
        keep = [i for i, c in enumerate(counts) if len(c)]
        # alike vectors share blocks, which makes the bounds tight
        keep.sort(key=lambda i: (np.sort(counts[i][:, 0]).astype(">i4").tobytes(), ids[i]))
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.y = np.asarray(y, float)[keep]
        self.weight = np.asarray(weight, float)[keep]
        self.counts = [counts[i] for i in keep]
        self.blocks, self.block = -(-len(keep) // block), block
        doc, term, x = self._vectors(self.counts)
        held = np.bincount(term, minlength=len(self.idf))
        self.row = np.full(len(self.idf), -1, np.int32)
        rows = np.flatnonzero(held > max(1.0, ROW_SHARE * len(keep)))
        self.row[rows] = np.arange(len(rows))
        dense = self.row[term] >= 0
        self.rows = np.zeros((len(rows), self.blocks * block))
        self.rows[self.row[term[dense]], doc[dense]] = x[dense]
        doc, term, x = doc[~dense], term[~dense], x[~dense]
        order = np.argsort(term, kind="stable")  # within a term the examples stay in their order
        self.doc, self.x = doc[order], x[order]
        self.many = np.bincount(term, minlength=len(self.idf)).astype(np.int32)
        self._derive()

    def _derive(self) -> None:
        """Where each term's postings begin, and for each term and block the largest weight."""
        self.row_largest = self.rows.reshape(len(self.rows), self.blocks, self.block).max(axis=2, initial=0.0)
        self.first = np.cumsum(self.many) - self.many
        term, of = np.repeat(np.arange(len(self.idf), dtype=np.int32), self.many), self.doc // self.block
        new = np.ones(len(of), bool)
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        self.block_x = np.maximum.reduceat(self.x, at) if len(at) else np.zeros(0)
        self.block_of = of[at]
        self.block_many = np.bincount(term[at], minlength=len(self.idf)).astype(np.int32)
        self.block_first = np.cumsum(self.block_many) - self.block_many

    def __getstate__(self) -> dict:
        """Without what ``_derive`` gives, and of the rows only what is in them: every task gets a copy."""
        derived = ("row_largest", "first", "block_x", "block_of", "block_many", "block_first")
        at = np.flatnonzero(self.rows)
        state = {k: v for k, v in self.__dict__.items() if k not in derived}
        return {**state, "counts": None, "rows": (self.rows.shape, at, self.rows.reshape(-1)[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, x = state["rows"]
        self.__dict__.update(state, rows=np.zeros(shape))
        self.rows.reshape(-1)[at] = x
        self._derive()

    def _vectors(self, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, term, weight) of all entries."""
        n = np.array([len(c) for c in counts], np.int64)
        flat = np.concatenate([np.zeros((0, 2), np.int32), *(np.asarray(c, np.int32).reshape(-1, 2) for c in counts)])
        doc, term = np.repeat(np.arange(len(counts), dtype=np.int32), n), flat[:, 0]
        x = np.log(flat[:, 1])
        x += 1
        x *= self.idf[term]
        norm = np.sqrt(np.bincount(doc, x * x, minlength=len(counts)))
        x /= np.where(norm > 0, norm, 1.0)[doc]
        return doc, term, x

    def unit(self, counts: np.ndarray | tuple) -> list[tuple[int, float]]:
        _, term, x = self._vectors([counts])
        return list(zip(term.tolist(), x.tolist(), strict=True))

    def nearest(self, counts: np.ndarray | tuple, k: int = NEIGHBOURS, leave_out: int | None = None) -> list[tuple[float, int]]:
        """[(cosine, place of the example), ...]: the k largest cosines above 0, ties to the smaller id."""
        return self.nearest_of([counts], k, None if leave_out is None else [leave_out])[0]

    def nearest_of(self, counts: list, k: int = NEIGHBOURS, leave_out: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of each of some texts; those whose terms have ``SPREAD`` postings go together, which bounds
        the memory."""
        out: list[list[tuple[float, int]]] = []
        at, held = 0, 0
        for i, c in enumerate(counts):
            cost = int(self.many[np.asarray(c, np.int32).reshape(-1, 2)[:, 0]].sum())
            if i > at and held + cost > SPREAD:
                out += self._nearest_of(counts[at:i], k, None if leave_out is None else leave_out[at:i])
                at, held = i, 0
            held += cost
        return out + self._nearest_of(counts[at:], k, None if leave_out is None else leave_out[at:])

    def _nearest_of(self, counts: list, k: int, leave_out: list[int] | None) -> list[list[tuple[float, int]]]:
        n, blocks, block = len(counts), self.blocks, self.block
        if not n or not blocks:
            return [[] for _ in counts]
        doc, term, x = self._vectors(counts)
        dense = self.row[term] >= 0
        q = np.zeros((n, len(self.rows)))
        q[doc[dense], self.row[term[dense]]] = x[dense]
        doc, term, x = doc[~dense], term[~dense], x[~dense]

        ends = np.searchsorted(doc, np.arange(n + 1))

        def added(first: np.ndarray, many: np.ndarray, to: np.ndarray, by: np.ndarray, width: int) -> np.ndarray:
            out = np.zeros((n, width))
            for i in range(n):  # one text's postings at a time
                own = slice(ends[i], ends[i + 1])
                m = many[term[own]]
                at = _spread(first[term[own]], m)
                out[i] = np.bincount(to[at], np.repeat(x[own], m) * by[at], minlength=width)
            return out

        bounds = q @ self.row_largest + added(self.block_first, self.block_many, self.block_of, self.block_x, blocks)
        scores = added(self.first, self.many, self.doc, self.x, blocks * block)
        opened = np.zeros((n, blocks), bool)

        def open_(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                of, here = np.flatnonzero(wanted[:, b]), slice(b * block, (b + 1) * block)
                # rounding makes equal sums comparable whatever their order of addition
                scores[of, here] = np.round(scores[of, here] + q[of] @ self.rows[:, here], 9)
            opened[wanted] = True

        # one more than k, as an example may be left out
        ahead = min(blocks, 1 + -(-(k + 1) // block))
        most = np.zeros((n, blocks), bool)
        np.put_along_axis(most, np.argpartition(-bounds, ahead - 1, axis=1)[:, :ahead], True, axis=1)
        open_(most & (bounds > 0))
        shown = np.where(np.repeat(opened, block, axis=1), scores, 0.0)
        if leave_out is not None:
            shown[np.arange(n), leave_out] = 0.0
        kth = -np.partition(-shown, k - 1, axis=1)[:, k - 1] if shown.shape[1] > k else np.zeros(n)
        open_(~opened & (bounds > 0) & (bounds >= kth[:, None] - 1e-8))
        scores[~np.repeat(opened, block, axis=1)] = 0.0
        if leave_out is not None:
            scores[np.arange(n), leave_out] = 0.0
        if scores.shape[1] > k:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        out: list[list[tuple[float, int]]] = [[] for _ in counts]
        for i, at in zip(*(v.tolist() for v in np.nonzero((scores > 0) & (scores >= kth[:, None]))), strict=True):
            out[i].append((float(scores[i, at]), at))
        return [sorted(near, key=lambda t: (-t[0], int(self.ids[t[1]]), t[1]))[:k] for near in out]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The weighted share of toxic neighbours; closer ones weigh more."""
        if not near:
            return 0.0
        at = [a for _, a in near]
        w = self.weight[at] / (_EPS + 1 - np.array([c for c, _ in near]))
        return float(w @ self.y[at] / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators steps: (votes, calibrated shares), both rising."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        if pools and pools[-1][3] == xi:
            pools[-1][0] += yi * wi
            pools[-1][1] += wi
        else:
            pools.append([yi * wi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, v, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += v
            pools[-1][3] = hi
    xs, ys = [], []
    for s, v, lo, hi in pools:
        xs += [lo, hi]
        ys += [s / v] * 2
    return np.array(xs), np.array(ys)


class ToxicityModel:
    """Vocabulary, index and calibration; ``judge`` gives (score, evidence) of a text."""

    def __init__(self, vocabulary: Vocabulary, ids: list[int], counts: list, y: np.ndarray, prior: float, df: np.ndarray, n_docs: int, k: int = NEIGHBOURS) -> None:
        y = np.asarray(y, float)
        self.k = k
        self.vocabulary = vocabulary
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        share = y.mean()
        weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
        idf = np.log((n_docs + 1) / (np.asarray(df, float) + 1)) + 1
        idf[: vocabulary.telling] *= TELLING
        none = np.array([not len(c) for c in counts])
        self.without = float((weight[none] @ y[none] + prior) / (weight[none].sum() + 1))
        self.index = BlockMaxIndex(idf, counts, ids, y, weight)
        self.steps = (np.array([0.0, 1.0]), np.array([prior, prior]))
        if len(self.index.ids):
            own = range(len(self.index.ids))
            votes = np.array([self.index.vote(x) for i in own[::TOGETHER] for x in self.index.nearest_of(self.index.counts[i : i + TOGETHER], k, list(own[i : i + TOGETHER]))])
            xs, ys = isotonic(votes, self.index.y, self.index.weight)
            # a pseudo-example at the prior keeps the ends off 0 and 1
            n = self.index.weight.sum()
            self.steps = (xs, (ys * n + prior) / (n + 1))
        self.index.counts = None  # only the calibration asks for them

    def judge(self, texts: list[str | None]) -> list[tuple[float, tuple]]:
        """The calibrated score of each text, and ((example id, cosine, toxic), ...) of its nearest examples."""
        if self.constant is not None:
            return [(self.constant, ()) for _ in texts]
        out = []
        for i in range(0, len(texts), TOGETHER):
            for near in self.index.nearest_of([self.vocabulary.counts(words_of(t)) for t in texts[i : i + TOGETHER]], self.k):
                score = float(np.interp(self.index.vote(near), *self.steps)) if near else self.without
                out.append((score, tuple((int(self.index.ids[at]), c, int(self.index.y[at])) for c, at in near)))
        return out


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many there are; counted over the whole table.

    A task sends one count for each term of the bounded vocabulary that it met.
    """

    @handing_back
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(len(vocabulary), np.int64)
        for b in batches:
            n += len(b)
            for i in range(0, len(b), TOGETHER):
                met = [vocabulary.counts(words_of(text))[:, 0] for text in b["text"].iloc[i : i + TOGETHER]]
                df += np.bincount(np.concatenate(met), minlength=len(df))
        met = np.flatnonzero(df)
        yield pd.DataFrame({"term": [-1, *met.tolist()], "n": [n, *df[met].tolist()]})

    got = docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(got["term"].tolist(), got["n"].tolist(), strict=True))
    return np.array([by.get(i, 0) for i in range(len(vocabulary))], np.int64), int(by.get(-1, 0))


def train(docs: DataFrame, labels: DataFrame, examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> ToxicityModel:
    """Reads the bounded examples, then the document frequencies of the whole table."""
    toxic, clean = (sample_ids(labels.where(F.col("toxic") == v), "toxic", examples) for v in (1, 0))
    both = toxic.unionByName(clean).groupBy("lid").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    got = (
        docs.select(F.col("doc_id").cast("long").alias("lid"), "text").join(F.broadcast(both), "lid")
        .groupBy("lid").agg(F.first("y").alias("y"), F.max(F.coalesce("text", F.lit(""))).alias("text")).orderBy("lid").toPandas()
    )
    base = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    y, lids = got["y"].to_numpy(int), got["lid"].tolist()
    texts = got.pop("text").tolist()
    telling = select_terms(texts, y) if len(set(y.tolist())) == 2 else []
    vocabulary = Vocabulary(all_terms(texts, telling) if len(set(y.tolist())) == 2 else [], len(telling))
    df, n = document_counts(docs, vocabulary) if len(vocabulary) else (np.zeros(0), 0)
    counts = [vocabulary.counts(words_of(t)) for t in texts]
    texts.clear()
    return ToxicityModel(vocabulary, lids, counts, y, float(base if base is not None else 0.5), df, n, k)


def judged(docs: DataFrame, model: ToxicityModel, name: str = "_toxicity") -> DataFrame:
    """``docs`` with column ``name``: score, and evidence as an array of (doc_id, cosine, toxic)."""
    if name != fresh(docs, name):
        raise ValueError(f"the documents have a column {name}; name another one")

    @F.pandas_udf("struct<score: double, evidence: array<struct<doc_id: long, cosine: double, toxic: int>>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hand_back()
        for texts in batches:
            for at in range(0, len(texts), PIECE):
                out = model.judge(texts.iloc[at : at + PIECE].tolist())
                yield pd.DataFrame({
                    "score": [s for s, _ in out],
                    "evidence": [[{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in e] for _, e in out],
                })
        hand_back()

    return docs.withColumn(name, judge(F.col("text")))


def score_documents(docs: DataFrame, labels: DataFrame, examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, name: str = "_toxicity") -> DataFrame:
    docs = bounded_batches(docs)
    model = train(docs, labels, examples, k)
    hand_back()
    return judged(docs, model, name)


def op1_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = score_documents(docs, labels)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("_toxicity.evidence").alias("evidence"),
    )
