"""Toxicity from the nearest labelled examples.

Texts are TF-IDF vectors over the terms that tell the labels apart or, where a
text has none of these, over all terms of the examples. A block-max inverted
index over the labelled examples finds a text's exact nearest ones by cosine: every posting list is cut into blocks of neighbouring
examples, a block's largest weights bound all its cosines, and blocks are
scored in the order of their bounds until no bound can reach the k-th best.
The neighbours vote, weighted by distance; the share of votes is calibrated on
the examples themselves, each left out of its own vote.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..session import checkpoint
from .common import SLICE, held_out, least_hashes, slices

#: Labelled examples at most (smallest id hashes) and terms that tell the labels apart at most: bounds on the index, which is broadcast.
EXAMPLES, TERMS = 8_000, 4_096
#: Rows a term must be in, and how strongly it must go with a label (the G statistic).
LEAST_ROWS, LEAST_G = 3, 10.8
NEIGHBOURS, BLOCK, PREFIX = 15, 64, 5
#: Blocks scored at first (then twice as many each time), and examples that votes are calibrated on at most.
STEP, CALIBRATED = 4, 2_000
CUT = 0.3
#: Commonest terms that whole texts are compared by from dense rows; bounds memory only.
DENSE = 512
#: Texts whose common terms are multiplied at once.
TOGETHER = 64
#: Terms whose entries the driver fetches at once.
FETCHED = 1 << 16
#: Votes whose result a task remembers; bounds memory only.
REMEMBERED = 5_000

_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    """Counts of the lower-case words and of the beginnings of long ones."""
    found = Counter(_LETTERS.findall(text.lower()))
    for word, n in list(found.items()):
        if len(word) > PREFIX:
            found[word[:PREFIX] + "-"] += n
    return found


def _g(a, b, rows1: int, rows0: int):
    """How unlikely the split of a term's rows (a with label 1, b with 0) is by chance."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, out = rows1 + rows0, np.zeros(len(a))
    for seen, row, col in ((a, a + b, rows1), (b, a + b, rows0), (rows1 - a, n - a - b, rows1), (rows0 - b, n - a - b, rows0)):
        expected = row * col / n
        out += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """Examples as unit vectors, by term: (example, weight) in example order,
    cut into the blocks that have the term, each with its largest weight.
    ``vectors`` are a dict an example, or arrays (example, term, weight)."""

    def __init__(self, vocabulary: pa.Array | list[str], idf: np.ndarray, vectors, labels: np.ndarray, ids: np.ndarray):
        if isinstance(vectors, list):
            vectors = (np.array([i for i, x in enumerate(vectors) for _ in x], np.int64), np.array([t for x in vectors for t in x], np.int64),
                       np.array([w for x in vectors for w in x.values()], np.float64))
        example, term, weight = vectors
        first = np.lexsort((term, -weight, example))
        first = first[np.flatnonzero(np.diff(example[first], prepend=-1))]
        order = np.lexsort((term[first], labels))  # like to like: tight blocks
        del first
        self.words = vocabulary
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in self._terms()), np.uint64, len(vocabulary))
        self.code = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.code]
        self.idf, self.labels, self.ids = idf, labels[order].astype(float), ids[order]
        self.blocks = -(-len(order) // BLOCK)
        example = np.argsort(order)[example].astype(np.int32)
        by = np.lexsort((example, term))
        self.example, self.weight, term = example[by], weight[by], term[by]
        del by, example, weight
        block = self.example // BLOCK
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block, self.most = block[new], np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.start = np.append(new, len(term)).astype(np.int32)  # of a block's entries
        self.first = np.searchsorted(term[new], np.arange(len(vocabulary) + 1)).astype(np.int32)  # block of a term
        self.known: dict = {}

    def _terms(self) -> list[str]:
        return self.words if isinstance(self.words, list) else self.words.to_pylist()

    @property
    def vocabulary(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self._terms())}

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and unit weights (1 + log tf) * idf; both empty if no
        term is known. Terms are found by a 64-bit hash, in a sorted array: a dict
        of them would take a task some twenty times the memory."""
        if not len(counts) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        asked = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
        place = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        known = self.hashes[place] == asked
        at = self.code[place[known]].astype(np.int64)
        if not len(at):
            return at, np.zeros(0)
        n = np.fromiter(counts.values(), np.float64, len(counts))[known]
        order = np.argsort(at)
        at, w = at[order], ((1 + np.log(n)) * self.idf[at])[order]
        return at, w / np.sqrt(w @ w)

    def nearest(self, at: np.ndarray, weights: np.ndarray, without: int = -1) -> list[tuple[float, int]]:
        """The NEIGHBOURS examples of greatest cosine above 0, best first,
        exactly. Of equal cosines those stay that were scored first."""
        sizes = self.first[at + 1] - self.first[at]
        part = _runs(self.first[at], sizes)
        weights, block = np.repeat(weights, sizes), self.block[part]
        bounds = np.bincount(block, weights * self.most[part], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        row = np.empty(self.blocks, np.int64)
        row[order] = np.arange(self.blocks)
        order = order[:np.count_nonzero(bounds > 0)]
        by = np.argsort(row[block].astype(np.int16 if self.blocks < 2**15 else np.int64), kind="stable")
        part, weights = part[by], weights[by]
        edges = np.append(0, np.cumsum(np.bincount(block, minlength=self.blocks)[order]))
        best, who = np.zeros(0), np.zeros(0, np.int64)
        k, step = 0, STEP
        while k < len(order):
            some = order[k:k + step]
            if len(best) == NEIGHBOURS and bounds[some[0]] <= best[-1]:
                break
            these = part[edges[k]:edges[k + len(some)]]
            sizes = self.start[these + 1] - self.start[these]
            posting = _runs(self.start[these], sizes)
            found = self.example[posting]
            scores = np.bincount((row[found // BLOCK] - k) * BLOCK + found % BLOCK,
                                 np.repeat(weights[edges[k]:edges[k + len(some)]], sizes) * self.weight[posting], len(some) * BLOCK)
            if without >= 0 and without // BLOCK in some:
                scores[(row[without // BLOCK] - k) * BLOCK + without % BLOCK] = 0
            seen = np.flatnonzero(scores)
            best = np.concatenate([best, scores[seen]])
            who = np.concatenate([who, some[seen // BLOCK] * BLOCK + seen % BLOCK])
            top = np.argsort(-best, kind="stable")[:NEIGHBOURS]
            best, who = best[top], who[top]
            k, step = k + len(some), 2 * step
        return list(zip(best.tolist(), who.tolist(), strict=True))

    def number(self, e: int, ids: np.ndarray, labels: np.ndarray) -> int:
        """The place of an example."""
        return int(np.flatnonzero((self.ids == ids[e]) & (self.labels == labels[e]))[0])

    def share(self, near: list[tuple[float, int]]) -> float:
        """The vote for label 1, each neighbour weighted by one over its distance."""
        w = np.array([1 / (1.02 - min(s, 1.0)) for s, _ in near])
        return float(w @ self.labels[[e for _, e in near]] / w.sum())

    def told(self, near: list[tuple[float, int]], levels: "Levels") -> tuple[float, list[int], list[float]]:
        if not near:
            return levels.empty, [], []
        return levels.of(self.share(near)), [int(self.ids[e]) for _, e in near], [round(s, 6) for s, _ in near]


class Levels:
    """From left-out votes to the share of label 1 among like votes, by isotonic regression."""

    def __init__(self, seen: list[tuple[float, float]], empty: float):
        pools: list[list[float]] = []  # (votes, sum of labels, lowest vote, highest vote)
        for vote, y in sorted(seen):
            pools.append([1, y, vote, vote])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                n, y2, _, high = pools.pop()
                pools[-1] = [pools[-1][0] + n, pools[-1][1] + y2, pools[-1][2], high]
        self.empty = empty
        self.votes = np.array([v for _, _, a, b in pools for v in (a, b)])
        self.levels = np.array([(y + 0.05) / (n + 0.5) for n, y, _, _ in pools for _ in (0, 1)])

    def of(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.levels)) if len(self.votes) else self.empty


class Model:
    """The two indexes, and a text's way to one of them."""

    def __init__(self, chosen: Index, whole: "Whole"):
        self.chosen, self.whole = chosen, whole

    def scores(self, texts: list[str], levels: tuple[Levels, Levels]) -> list[tuple[float, list[int], list[float]]]:
        out: list = [None] * len(texts)
        known, waiting = self.chosen.known, []
        for i, text in enumerate(texts):
            counts = terms(text)
            at, weights = self.chosen.vector(counts)
            if not len(at):
                waiting.append((i, *self.whole.vector(counts)))
                continue
            key = (at.tobytes(), weights.tobytes())
            if key not in known:
                told = self.chosen.told(self.chosen.nearest(at, weights), levels[0])
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = told
            out[i] = known[key]
        for k in range(0, len(waiting), TOGETHER):
            some = waiting[k:k + TOGETHER]
            for (i, at, weights), common in zip(some, self.whole.common_scores(some), strict=True):
                out[i] = self.whole.told(self.whole.nearest(at, weights, common=common) if len(at) else [], levels[1])
        return out


class Whole(Index):
    """Vectors of whole texts: they share terms with every block, so no bound
    skips any. All examples are scored, common terms from dense rows."""

    def __init__(self, *args):
        super().__init__(*args)
        self.first = self.start[self.first]  # entries, not blocks, of a term
        del self.start, self.block, self.most
        sizes = np.diff(self.first)
        self.row, common = np.full(len(sizes), -1, np.int32), np.argsort(-sizes, kind="stable")[:DENSE]
        self.row[common] = np.arange(len(common))
        self.common = None

    def __getstate__(self) -> dict:
        """For the broadcast: dense rows are laid out anew where they are used."""
        return self.__dict__ | {"common": None, "words": [], "weight": self.weight.astype(np.float32), "example": self.example.astype(np.min_scalar_type(len(self.labels)))}

    def dense(self) -> np.ndarray:
        if self.common is None:
            self.common = np.zeros((np.count_nonzero(self.row >= 0), len(self.labels)), np.float32)
            for t in np.flatnonzero(self.row >= 0):
                at = slice(self.first[t], self.first[t + 1])
                self.common[self.row[t], self.example[at]] = self.weight[at]
        return self.common

    def common_scores(self, vectors: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms give each of some vectors (number, terms, weights) with every example: one product."""
        dense = self.dense()
        asked = np.zeros((len(vectors), len(dense)), np.float32)
        for i, (_, at, weights) in enumerate(vectors):
            row = self.row[at]
            asked[i, row[row >= 0]] = weights[row >= 0]
        return asked @ dense

    def nearest(self, at: np.ndarray, weights: np.ndarray, without: int = -1, common: np.ndarray | None = None) -> list[tuple[float, int]]:
        rare = self.row[at] < 0
        sizes = self.first[at[rare] + 1] - self.first[at[rare]]
        posting = _runs(self.first[at[rare]], sizes)
        common = self.common_scores([(0, at, weights)])[0] if common is None else common
        scores = common + np.bincount(self.example[posting], np.repeat(weights[rare], sizes) * self.weight[posting], len(self.labels))
        if without >= 0:
            scores[without] = 0
        some = np.flatnonzero(scores >= max(np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS], 1e-12)) if len(scores) > NEIGHBOURS else np.flatnonzero(scores)
        some = some[np.argsort(-scores[some], kind="stable")][:NEIGHBOURS]
        return list(zip(scores[some].tolist(), some.tolist(), strict=True))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [terms(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("e"), pa.array([list(x) for x in found], pa.list_(pa.string())),
                                          pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], names=["e", "terms", "counts"])


def _postings(weights: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(example, term, weight) of all entries, fetched a range of terms at a time."""
    parts, rows, at = [], weights.select("code", "e", "w"), 0
    while at < size:
        part = rows.where((F.col("code") >= at) & (F.col("code") < at + FETCHED)).toArrow()
        parts.append(tuple(part.column(c).to_numpy().astype(t) for c, t in (("e", np.int32), ("code", np.int32), ("w", np.float64))))
        del part
        at += FETCHED
    return tuple(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int32) for k in range(3))


def _unit(example: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return weight / np.sqrt(np.bincount(example, weight * weight, n))[example]


class Scorer:
    """The broadcast Model and its Levels, as tasks use them."""

    def __init__(self, sent, levels: tuple[Levels, Levels]):
        self.sent, self.levels = sent, levels

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[float]]]:
        return self.sent.value.scores(texts, self.levels)

    @property
    def vocabulary(self) -> dict[str, int]:
        return self.sent.value.chosen.vocabulary

    @property
    def labels(self) -> np.ndarray:
        return self.sent.value.chosen.labels


def build(docs: DataFrame, labels: DataFrame, label: str, examples: int) -> Scorer:
    """The index of the labelled examples, calibrated.

    Spark counts the terms of the examples, numbers them and weighs them. The
    driver gets the numbers of the index as arrays, a range of terms at a time,
    and the terms as one Arrow column: all bounded by ``examples``. The votes
    for the calibration are searched on executors through the broadcast index."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    # at most ``examples`` rows are numbered in one window
    number = F.row_number().over(Window.orderBy("doc_id", "label")) - 1
    sample = F.broadcast(least_hashes(known, examples, "doc_id", "label").distinct())
    picked = checkpoint(docs.select("doc_id").join(sample, "doc_id").distinct().withColumn("e", number))
    found = picked.orderBy("e").toArrow()
    ids, ys = found.column("doc_id").to_numpy(), found.column("label").to_numpy().astype(float)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("e", "text")
    counted = texts.mapInArrow(_counts, "e int, terms array<string>, counts array<int>")
    # an id with several texts: the larger count
    entries = checkpoint(counted.select("e", F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("e", F.col("x.terms").alias("term"))
                         .agg(F.max("x.counts").alias("n")))
    by_term = (entries.join(F.broadcast(picked.select("e", "label")), "e").groupBy("term")
               .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")))
    vocabulary = checkpoint(dense_index(by_term, ["term"], out="code"))
    total, ones = len(ids), int(ys.sum())
    weight = (1 + F.log("n")) * (F.log(F.lit(1.0 + total) / (1 + F.col("a") + F.col("b"))) + 1)
    weights = checkpoint(entries.join(vocabulary, "term").select("code", "e", weight.alias("w")).repartitionByRange("code"))
    listed = vocabulary.orderBy("code").select("term", "a", "b").toArrow()
    words, a, b = listed.column("term").combine_chunks(), *(listed.column(c).to_numpy().astype(float) for c in "ab")
    idf = np.log((1 + total) / (1 + a + b)) + 1
    # the terms that tell the labels apart
    g = np.where(a + b >= LEAST_ROWS, _g(a, b, ones, total - ones), 0) if 0 < ones < total else np.zeros(len(a))
    best = np.lexsort((np.arange(len(g)), -g))[:TERMS]
    telling = np.sort(best[g[best] >= LEAST_G])
    example, term, weight = _postings(weights, len(words))
    model = Model(_part(words.take(pa.array(telling)), idf[telling], example, term, weight, telling, ys, ids),
                  _part(words, idf, example, term, weight, None, ys, ids))
    has, told = np.bincount(example, minlength=total) > 0, np.zeros(total, bool)
    told[example[np.isin(term, telling)]] = True
    del example, term, weight
    sent = spark.sparkContext.broadcast(model)
    del model
    chosen, rest = _spread(np.flatnonzero(told)), _spread(np.flatnonzero(has & ~told))
    votes = _votes(weights, sent, {int(e): 0 for e in chosen} | {int(e): 1 for e in rest}, {int(t): k for k, t in enumerate(telling)}, ids, ys)
    empty = (ys[~told].sum() + 0.5) / ((~told).sum() + 10), (ys[~has].sum() + 0.5) / ((~has).sum() + 10)
    levels = tuple(Levels([(v, ys[e]) for which, e, v in votes if which == k], float(empty[k])) for k in (0, 1))
    return Scorer(sent, levels)


def _part(words: pa.Array, idf: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray, telling: np.ndarray | None,
          ys: np.ndarray, ids: np.ndarray) -> Index:
    """The index over some terms, or over all; examples without any are not in it."""
    if telling is not None:
        keep = np.isin(term, telling)
        example, term, weight = example[keep], np.searchsorted(telling, term[keep]).astype(np.int32), weight[keep]
    full = np.bincount(example, minlength=len(ids)) > 0
    place = (np.cumsum(full) - 1).astype(np.int32)
    return (Whole if telling is None else Index)(words, idf, (place[example], term, _unit(example, weight, len(ids))), ys[full], ids[full])


def _spread(among: np.ndarray) -> np.ndarray:
    """At most CALIBRATED of them, spread evenly."""
    return among[::-(-len(among) // CALIBRATED) or 1]


def _votes(weights: DataFrame, sent, which: dict[int, int], telling: dict[int, int], ids: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, float]]:
    """(index, example, vote) of examples that are left out of their own search."""
    spark = weights.sparkSession
    if not which:
        return []
    asked = F.broadcast(spark.createDataFrame([(e, k) for e, k in which.items()], "e int, which int"))
    entries = weights.join(asked, "e")
    if telling:  # of the first index, only its own terms
        own = F.broadcast(spark.createDataFrame([(c, k) for c, k in telling.items()], "code long, place int"))
        entries = entries.join(own, "code", "left").where("which = 1 OR place IS NOT NULL")
    else:
        entries = entries.withColumn("place", F.lit(None).cast("int"))
    rows = entries.groupBy("which", "e").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("which") == 0, F.col("place").cast("long"))
                                                                                  .otherwise(F.col("code")).alias("at"), "w"))).alias("x"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                index = sent.value.whole if r["which"] else sent.value.chosen
                at, w = np.array([x["at"] for x in r["x"]]), np.array([x["w"] for x in r["x"]])
                near = index.nearest(at, w / np.sqrt(w @ w), index.number(r["e"], ids, ys))
                if near:
                    out.append((r["which"], r["e"], index.share(near)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
                                             names=["which", "e", "vote"])

    return [tuple(r) for r in rows.mapInArrow(vote, "which int, e int, vote double").collect()]


RESULT = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>"


def scores(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from CUT on), and the evidence:
    ids and cosines of the nearest examples, best first.

    Examples come only from labelled rows outside the held-out part; label, id
    and other columns never enter a score. A text without a term that tells
    the labels apart is compared by all its terms. Null and empty texts and those
    of unknown terms only have no neighbours and get the rate of label 1 among
    examples without terms. Repeated rows repeat; null ids are never examples. Texts never
    move: the index, of bounded size, is broadcast."""
    scorer = build(docs, labels, label, examples)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = scorer.scores([text or "" for text in batch.column("text").to_pylist()])
            new = [pa.array([x[0] for x in told], pa.float64()), pa.array([int(x[0] >= CUT) for x in told], pa.int32()),
                   pa.array([x[1] for x in told], pa.list_(pa.int64())), pa.array([x[2] for x in told], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *new],
                                             names=["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(rows, RESULT)


def without_toxic(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """The rows of ``docs`` whose text scores below CUT, all columns kept."""
    scorer = build(docs, labels, label, examples)

    def keep(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE))
        return pa.array([x[0] < CUT for part in parts for x in scorer.scores([text or "" for text in part])], pa.bool_())

    return docs.where(F.arrow_udf(keep, "boolean")(F.col("text")))
