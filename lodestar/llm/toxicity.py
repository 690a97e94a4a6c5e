"""Toxicity scores by votes of the nearest labelled examples under exact TF-IDF cosine.

Labels teach in two places only: which terms (words and word beginnings) make up
the vector space, and how the neighbours vote. The examples form a block-max
inverted index: for each term its postings by block of examples and the largest
weight in each block. A query bounds every block from these maxima, visits blocks
from the highest bound down and stops when the k-th neighbour found beats the
next bound, so the neighbours are exact. Votes are weighted by distance, and
isotonic regression on leave-one-out votes turns them into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import map_batches, pick

#: The model is fitted on at most this many examples of each label and terms; with 8 bytes a posting that bounds it by 67 MB.
EXAMPLES_PER_LABEL = 4096
TERMS = 1024
#: A term joins if its presence depends on the label with this likelihood-ratio statistic (one chance in ten million) and such log-odds.
LIKELIHOOD_RATIO = 28.0
LEAST_ODDS = 2.1
BEGINNINGS = (4, 5, 6)
BLOCK = 64
NEIGHBOURS = 15
EVIDENCE = 3
#: Added to a neighbour's distance before its vote is divided by it, and weight of the prior among the votes.
SOFTEN = 0.1
PRIOR = 2.0
THRESHOLD = 0.3
#: Different words a task remembers before it starts anew.
WORDS_KEPT = 200_000

_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, as terms."""
    return [f"={word}", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


class Model:
    """Terms, examples and calibration; plain arrays, so that it can be broadcast."""

    def __init__(self, terms: list[str], idf: np.ndarray, rows: list[tuple], rate: float, weights: tuple[float, float]):
        """``rows``: for each example its doc_id, label and ``{term number: count}``."""
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf, self.rate, self.class_weight = idf, rate, np.array(weights)
        vectors = [(self.vector(counts), label, doc_id) for doc_id, label, counts in rows]
        flat = [(label, doc_id) for (at, _), label, doc_id in vectors if not len(at)]
        zero = [self.class_weight[label] for label, _ in flat]
        self.zero_score = (sum(w for w, (label, _) in zip(zero, flat) if label) + PRIOR * rate) / (sum(zero) + PRIOR)
        # neighbours of one block share their heaviest terms; doc_id has no part in the order
        vectors = sorted((v for v in vectors if len(v[0][0])), key=lambda v: (int(v[0][0][np.argmax(v[0][1])]), v[0][0].tolist(), v[0][1].tolist(), v[1]))
        self.labels = np.array([label for _, label, _ in vectors], dtype=np.int64)
        self.doc_ids = [doc_id for _, _, doc_id in vectors]
        blocks = max(1, -(-len(vectors) // BLOCK))
        postings = defaultdict(list)
        for place, ((at, weight), _, _) in enumerate(vectors):
            for t, w in zip(at.tolist(), weight.tolist()):
                postings[t].append((place, w))
        self.block_max = np.zeros((len(terms), blocks))
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for t, found in postings.items():
            place, weight = np.array([p for p, _ in found]), np.array([w for _, w in found])
            np.maximum.at(self.block_max[t], place // BLOCK, weight)
            self.postings[t] = place, weight, np.searchsorted(place, np.arange(blocks + 1) * BLOCK)
        self.calibrate([v[0] for v in vectors])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length TF-IDF weights."""
        at = np.array(sorted(counts), dtype=np.int64)
        weight = np.array([1 + np.log(counts[t]) for t in at.tolist()]) * self.idf[at]
        return at, weight / np.sqrt((weight * weight).sum()) if len(at) else weight

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above zero, ties to the earlier place; exact."""
        bounds = weight @ self.block_max[at]
        found: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or len(found) >= k and bounds[block] < -found[-1][0] - 1e-9:
                break
            sums = np.zeros(BLOCK)
            for t, w in zip(at.tolist(), weight.tolist()):
                if self.block_max[t, block] > 0:
                    place, value, ends = self.postings[t]
                    part = slice(ends[block], ends[block + 1])
                    sums[place[part] - block * BLOCK] += w * value[part]
            for i in np.flatnonzero(sums).tolist():
                if block * BLOCK + i != without:
                    found.append((-round(float(sums[i]), 12), block * BLOCK + i))
            found = sorted(found)[:k]
        return [(min(1.0, -s), p) for s, p in found]

    def votes(self, near: list[tuple[float, int]]) -> float:
        """Weighted share of toxic neighbours, drawn to the overall rate."""
        up, all_of = PRIOR * self.rate, PRIOR
        for similarity, place in near:
            vote = self.class_weight[self.labels[place]] * similarity * similarity / (SOFTEN + 1 - similarity)
            up += vote * self.labels[place]
            all_of += vote
        return up / all_of

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic regression of the labels on leave-one-out votes, weighted to the true label rate."""
        raw = np.array([self.votes(self.nearest(*v, without=i)) for i, v in enumerate(vectors)])
        pools: list[list[float]] = []  # lowest vote, highest vote, weight, weighted labels
        for i in np.argsort(raw, kind="stable").tolist():
            weight = self.class_weight[self.labels[i]]
            pools.append([raw[i], raw[i], weight, weight * self.labels[i]])
            while len(pools) > 1 and (pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2] or pools[-2][1] == pools[-1][0]):
                low, high, w, y = pools.pop()
                pools[-1][1] = high
                pools[-1][2] += w
                pools[-1][3] += y
        smooth = 0.5 * min(self.class_weight)
        self.knots = np.array([x for low, high, _, _ in pools for x in (low, high)])
        self.levels = np.array([(y + smooth * self.rate) / (w + smooth) for _, _, w, y in pools for _ in range(2)])

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """Probability between 0 and 1, and the nearest examples; without any term the rate of such examples."""
        if not counts or not len(self.knots):
            return float(self.zero_score), []
        near = self.nearest(*self.vector(counts))
        return (float(np.interp(self.votes(near), self.knots, self.levels)) if near else float(self.zero_score)), near


class Terms:
    """Counts of the model's terms in texts, looking at each different word once."""

    def __init__(self, number: dict[str, int]):
        self.number, self.known, self.hits = number, set(), {}

    def count(self, text: str | None) -> dict[int, int]:
        words = _WORD.findall((text or "").lower())
        for word in set(words).difference(self.known):
            if len(self.known) >= WORDS_KEPT:
                self.known, self.hits = set(), {}
            self.known.add(word)
            if found := [self.number[t] for t in terms_of(word) if t in self.number]:
                self.hits[word] = found
        present = self.hits.keys() & set(words)
        counts: Counter[int] = Counter()
        for word, n in Counter(w for w in words if w in present).items() if present else ():
            for t in self.hits[word]:
                counts[t] += n
        return dict(counts)


def _drawn(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, toxic)`` of the bounded sample and the number of usable labels of each kind."""
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    usable = materialise(usable, "toxicity-labels")
    numbers = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))

    def draw(label: int) -> DataFrame:
        # a bound on the hash first, so that tasks send about the sample and not one each
        bound = int(min(1.0, (1.2 * per_label + 100) / max(numbers.get(label, 0), 1)) * (1 << 40))
        return usable.where((F.col("toxic") == label) & (place <= F.lit(bound))).orderBy(place, "doc_id").limit(per_label)

    return draw(0).unionByName(draw(1)), numbers


def fit(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES_PER_LABEL, n_terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold; nothing if no label is usable.

    Of a document with several labels the highest counts; of repeated rows with
    one doc_id one teaches. The driver holds the sample's selected term counts,
    at most ``2 * per_label * n_terms`` numbers.
    """
    docs, labels = pick(docs, doc_id=id_col, text=text_col), pick(labels, doc_id="doc_id", toxic=label_col)
    sample, numbers = _drawn(docs, labels, per_label)
    if not sum(numbers.values()):
        return None
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).dropDuplicates(["toxic", "text"])  # at most 2 * per_label narrow rows are broadcast
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("toxic", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType())])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": [], "toxic": [], "term": [], "n": []}
            for doc_id, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                counts: Counter[str] = Counter()
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    for term in terms_of(word):
                        counts[term] += n
                counts[""] = 1  # keeps texts without any word among the examples
                for name, values in zip(out, (doc_id, toxic, None, None)):
                    out[name] += [values] * len(counts) if name in ("doc_id", "toxic") else list(counts if name == "term" else counts.values())
            return out

        return step

    found = materialise(map_batches(texts, make, schema), "toxicity-terms")
    one = F.sum(F.col("toxic")).cast("double")
    by_term = found.groupBy("term").agg(one.alias("one"), F.count(F.lit(1)).cast("double").alias("all"))
    sizes = by_term.where("term = ''").first()
    n_one, n_all = sizes["one"], sizes["all"]
    n_zero, zero = n_all - n_one, F.col("all") - F.col("one")
    odds = F.log((F.col("one") + 0.5) / F.lit(n_one + 1)) - F.log((zero + 0.5) / F.lit(n_zero + 1))
    # likelihood-ratio statistic of the two-by-two table of label and presence
    cells = [(F.col("one"), n_one, F.col("all")), (zero, n_zero, F.col("all")), (F.lit(n_one) - F.col("one"), n_one, F.lit(n_all) - F.col("all")), (F.lit(n_zero) - zero, n_zero, F.lit(n_all) - F.col("all"))]
    ratio = sum((F.when(c > 0, 2 * c * F.log(c * F.lit(n_all) / (F.lit(of) * n))).otherwise(0.0) for c, of, n in cells), F.lit(0.0))
    chosen = by_term.where("term <> ''").where(F.abs(odds) >= LEAST_ODDS).withColumn("g", ratio).where(F.col("g") >= LIKELIHOOD_RATIO)
    chosen = chosen.orderBy(F.desc("g"), "term").limit(n_terms).select("term", "all").collect()
    terms = [r["term"] for r in chosen]
    idf = np.log((n_all + 1) / (np.array([r["all"] for r in chosen]) + 1)) + 1
    number = {t: i for i, t in enumerate(terms)}
    kept = found.where(F.col("term").isin([*terms, ""])).groupBy("doc_id", "toxic").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    rows = [(r["doc_id"], r["toxic"], {number[t["term"]]: t["n"] for t in r["terms"] if t["term"]}) for r in kept.collect()]
    weights = tuple(numbers.get(k, 0) / max(1.0, n) for k, n in ((0, n_zero), (1, n_one)))
    return Model(terms, idf, sorted(rows, key=str), numbers.get(1, 0) / sum(numbers.values()), weights)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` of every row, without a shuffle.

    ``evidence`` lists the nearest examples with cosine and label. Null and empty
    texts hold no term and get the rate of such examples; without a model every
    score is 0. Repeated rows stay repeated; other columns are ignored; whole
    texts are read whatever their length.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType
    near = T.ArrayType(T.StructType([T.StructField("doc_id", kind), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()), T.StructField("evidence", near)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        terms = Terms(model.number) if model else None

        def step(batch: pa.RecordBatch) -> dict:
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                value, found = model.score(terms.count(text)) if model else (0.0, [])
                scores.append(value)
                evidence.append([{"doc_id": model.doc_ids[p], "similarity": s, "toxic": int(model.labels[p])} for s, p in found[:EVIDENCE]])
            return {"doc_id": batch.column("doc_id"), "score": scores, "evidence": evidence}

        return step

    scored = map_batches(docs, make, schema)
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept, in one pass without a shuffle.

    Null and empty texts are scored like any text without terms; without a model
    nothing is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms = Terms(model.number) if model else None
        for batch in batches:
            texts = batch.column(text_col)
            kept = [not model or model.score(terms.count(text.as_py()))[0] < threshold for text in texts]
            yield batch.filter(pa.array(kept, type=pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(reject, docs.schema)
