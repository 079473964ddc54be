"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import textkit
from lexspark.llm.quality import one_text_each
from lexspark.session import cut

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 30_000
#: Least worth of a feature: its log odds of toxic documents, either way, times the root of the number of its documents.
WORTH = 6.0
#: Beginnings of words, in bytes, that are features beside the words: they carry over to other endings.
PREFIXES = (4, 5, 6)
STEPS, LEARNING_RATE, RIDGE = 400, 0.1, 1e-4
THRESHOLD = 0.3

_WORD_GAP = np.ones(256, bool)
_WORD_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words of some rows, one column for the word and each prefix, and the rows' first words.

    Words are runs of ASCII letters and digits (A-Z as a-z) and bytes beyond ASCII. A word no longer than a prefix has
    no such prefix (0).
    """
    starts, ends, first = textkit.spans(_WORD_GAP[data], offsets)
    columns = [textkit.span_hashes(data, starts, ends)]
    for k in PREFIXES:
        part = textkit.mix(textkit.span_hashes(data, starts, np.minimum(starts + k, ends)) + np.uint64(k))
        part[ends - starts <= k] = 0
        columns.append(part)
    return np.stack(columns, axis=1), first


@dataclass
class Ordinal:
    """Weights shared by all thresholds: P(grade > k) is the logistic of weights · x - thresholds[k]."""

    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds[None, :], -40, 40)))


def matrix(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row, feature and value, the logarithm of one more than the number of occurrences."""
    rows, places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    size = len(vocabulary)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    for at, _, data, offsets in textkit.blocks(column):
        hashes, first = tokens(data, offsets)
        word, _ = np.nonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        picked = hashes[maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)]]
        if not size or not len(picked):
            continue
        place = np.minimum(np.searchsorted(vocabulary, picked), size - 1)
        real = vocabulary[place] == picked
        word, place = word[real], place[real]
        row = np.searchsorted(first, word, "right") - 1
        pair, count = np.unique(row * size + place, return_counts=True)
        rows.append(pair // size + at)
        places.append(pair % size)
        values.append(np.log1p(count))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def fit(n: int, rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, vocabulary: np.ndarray) -> Ordinal:
    """Maximum likelihood of the cumulative logistic model with a ridge, by Adam from zero weights."""
    top = max(1, int(grades.max())) if n else 1
    share = np.array([(np.count_nonzero(grades > k) + 0.5) / (n + 1) for k in range(top)])
    # thresholds as a first one and positive steps
    start = np.log((1 - share) / share)
    gaps = np.log(np.maximum(1e-3, np.diff(start)))
    params = np.concatenate([np.zeros(len(vocabulary)), start[:1], gaps])
    d = len(vocabulary)
    m, v = np.zeros_like(params), np.zeros_like(params)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1 if n and d else 1):
        theta = params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])
        s = np.bincount(rows, params[places] * values, n)
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        low = logistic(np.nan_to_num(bounds[grades], neginf=-1e3) - s)
        high = logistic(np.nan_to_num(bounds[grades + 1], posinf=1e3) - s)
        slope = -(low + high - 1) / n  # of the loss by s
        mass = np.maximum(high - low, 1e-12)
        by_theta = np.zeros(top + 2)
        np.add.at(by_theta, grades + 1, -(high * (1 - high)) / mass / n)
        np.add.at(by_theta, grades, (low * (1 - low)) / mass / n)
        t = by_theta[1:-1]
        tail = np.cumsum(t[::-1])[::-1]
        grad = np.concatenate([np.bincount(places, slope[rows] * values, d) + RIDGE * params[:d], tail[:1], tail[1:] * np.exp(params[d + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])
    return Ordinal(vocabulary, params[:d], theta)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on up to `rows` labelled documents; the driver gets those rows' sparse features and the features' statistics.

    A label's whole number is its grade: 0 is not toxic, higher is worse, and there are as many thresholds as the highest
    has; labels that only tell toxic (1) from not (0) give one threshold. Of several for one id the largest counts;
    negative ones are 0. Rows with a null label, id or text are not learned from; of several texts for one id, that of
    the least hash, then the least. Every word and beginning of a word of the sample is a feature if it tells toxic
    from other documents well enough for its number of documents (WORTH); rare ones are not left out for being rare.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.greatest(F.max("toxic"), F.lit(0)).cast("int").alias("y"))
    # at most `rows` ids and marks, so that the texts need no shuffle to meet them
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    sample = cut(one_text_each(own.join(known, "doc_id")), "labelled")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            toxic: list[np.ndarray] = []
            y = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for at, _, data, offsets in textkit.blocks(batch.column(0)):
                hashes, first = tokens(data, offsets)
                for i in range(len(offsets) - 1):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    found.append(own[own != 0])
                    toxic.append(np.full(len(found[-1]), y[at + i]))
            feature, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
            marks = np.bincount(place, np.concatenate([np.zeros(0), *toxic]), len(feature))
            docs = np.bincount(place, minlength=len(feature))
            for i in range(0, len(feature), 50_000):
                columns = (feature.view(np.int64), docs, marks.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], names=["f", "docs", "marks"])

    totals = sample.agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("p")).first()
    counts = sample.mapInArrow(presence, "f long, docs long, marks long").groupBy("f")
    counts = counts.agg(F.sum("docs").alias("docs"), F.sum("marks").alias("marks"))
    p, q = float(totals["p"]), float(totals["n"] - totals["p"])
    odds = F.log((F.col("marks") + 0.5) / (p + 1)) - F.log((F.col("docs") - F.col("marks") + 0.5) / (q + 1))
    worth = F.abs(odds) * F.sqrt("docs")
    vocabulary = np.sort(counts.where(worth >= WORTH).select("f").toArrow().column("f").to_numpy().view(np.uint64))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, values = matrix(batch.column(0), vocabulary)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c)) for c in (places, values)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["y", "places", "values"])

    table = sample.mapInArrow(sparse, "y int, places array<long>, values array<double>").toArrow()
    y = table.column("y").to_numpy()
    lists = table.column("places").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(y)), sizes)
    places = lists.flatten().to_numpy()
    values = table.column("values").combine_chunks().flatten().to_numpy()
    return fit(len(y), at, places, values, y.astype(np.int64), vocabulary)


SCHEMA = "severity double, grade int, p_toxic double, toxic boolean"


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with severity (expected grade), grade (likeliest), p_toxic (P(grade > 0)) and toxic (p_toxic >= THRESHOLD).

    Every word of the whole text counts. Null, empty and wordless texts: the score of a text without known features.
    No labels or none of one kind: the labels' share for every row. Repeated rows: equal scores. Empty table: empty
    result. Columns named like the new ones are replaced.
    """
    model = train(docs, labels, text, doc_id)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in names]

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ': ') for c in SCHEMA.split(', '))}>")
    def score(texts: pa.Array) -> pa.Array:
        rows, places, values = matrix(texts, model.vocabulary)
        s = np.bincount(rows, model.weights[places] * values, len(texts)) if len(rows) else np.zeros(len(texts))
        above = model.above(s)
        edges = np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1)
        grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)
        columns = (above.sum(axis=1), grade, above[:, 0], above[:, 0] >= THRESHOLD)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)

    out = docs.select(*keep, score(F.coalesce(F.col(text), F.lit(""))).alias("__score"))
    return out.select(*keep, *[F.col(f"__score.{n}").alias(n) for n in names])
