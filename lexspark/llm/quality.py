"""Quality by a generalised additive model with pairwise interactions: cyclic boosted shallow trees as lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm import textkit

#: Most labelled rows that the model is fitted on; those of least hash of their id.
SAMPLE_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 80, 0.1
#: Held out: crc32 of the id as text modulo FOLDS is 0.
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_bytes", "log_line_words", "upper_share", "caps_words", "symbol_share", "bang_share", "bar_share",
    "odd_share", "digit_share", "stop_share", "comma_share", "distinct_words", "repeated_neighbours", "top_word_share",
    "distinct_lines", "distinct_bigrams", "short_words",
)


def _mask(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(text.encode(), np.uint8)] = True
    return out


_CLASSES = {
    "upper": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "letter": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "symbol": _mask("!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"), "bang": _mask("!"), "bar": _mask("|"), "odd": _mask("#$%&*@^~"),
    "digit": _mask("0123456789"), "stop": _mask("."), "comma": _mask(","),
}
_LINE_GAP = _mask("\n")


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; of an empty text all are 0."""
    done = []
    for _, _, data, offsets in textkit.blocks(column):
        rows = len(offsets) - 1
        out = np.zeros((rows, len(FEATURES)))
        sums = {k: _by_row(m[data], offsets) for k, m in _CLASSES.items()}
        starts, ends, first = textkit.spans(textkit.SPACES[data], offsets)
        words = textkit.span_hashes(data, starts, ends)
        upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
        letter = np.concatenate([[0], np.cumsum(_CLASSES["letter"][data])])
        n_upper, n_letter = upper[ends] - upper[starts], letter[ends] - letter[starts]
        caps = np.concatenate([[0], np.cumsum((n_letter >= 2) & (n_upper == n_letter))])
        short = np.concatenate([[0], np.cumsum(ends - starts <= 3)])
        lines, line_ends, first_line = textkit.spans(_LINE_GAP[data], offsets)
        line_hash = textkit.span_hashes(data, lines, line_ends)
        n_words, n_lines = np.diff(first), np.diff(first_line)
        size = np.maximum(1, np.diff(offsets))
        some = np.maximum(1, n_words)
        out[:, 0] = np.log1p(n_words)
        out[:, 1] = size / some
        out[:, 2] = np.log1p(n_words / np.maximum(1, n_lines))
        out[:, 3] = sums["upper"] / np.maximum(1, sums["letter"])
        out[:, 4] = np.diff(caps[first]) / some
        for j, k in enumerate(("symbol", "bang", "bar", "odd", "digit", "stop", "comma"), 5):
            out[:, j] = sums[k] / some
        out[:, 17] = np.diff(short[first]) / some
        for i in np.flatnonzero(n_words).tolist():
            w = words[first[i] : first[i + 1]]
            ordered = np.sort(w)
            fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            n = len(w)
            # distinct words against a square root's growth, so that long texts do not count as repetitive
            out[i, 12] = (len(fresh) - 1) / min(n, 40 * np.sqrt(n))
            out[i, 13] = np.count_nonzero(w[1:] == w[:-1]) / n
            out[i, 14] = np.diff(fresh).max() / n
            own = line_hash[first_line[i] : first_line[i + 1]]
            out[i, 15] = len(np.unique(own)) / max(1, len(own))
            pairs = w[1:] * np.uint64(3) + w[:-1]
            out[i, 16] = len(np.unique(pairs)) / max(1, n - 1)
        out[n_words == 0] = 0
        done.append(out)
    return np.concatenate(done) if done else np.zeros((0, len(FEATURES)))


def _by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(total[offsets])


@dataclass
class Additive:
    """An intercept, one table over bins for each feature, and one over two features' coarse bins for each pair."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: a sum of looked-up values."""
        total = np.full(len(x), self.intercept)
        for j, edges in enumerate(self.edges):
            total += self.tables[j][np.searchsorted(edges, x[:, j], "right")]
        small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        for k, (i, j) in enumerate(self.pairs):
            total += self.pair_tables[k][small[i], small[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values of a tree of up to `leaves` leaves over ordered bins, each a Newton step; splits by gain."""
    value = lambda a, b: -g[a:b].sum() / (h[a:b].sum() + 1.0)
    worth = lambda gs, hs: gs * gs / (hs + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = worth(gl, hl) + worth(g[a:b].sum() - gl, h[a:b].sum() - hl) - worth(g[a:b].sum(), h[a:b].sum())
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], p, a + k + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a table once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    G, H = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = (
        (a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b),
        (G - cg[:-1, -1:] - cg[-1:, :-1] + a, H - ch[:-1, -1:] - ch[-1:, :-1] + b),
    )
    out = np.zeros_like(g)
    if not a.size:
        return 0.0, out
    gain = sum(x * x / (y + 1.0) for x, y in quads) - G * G / (H + 1.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    whole = lambda x: np.broadcast_to(x, gain.shape)[i, j]
    v = [-whole(x) / (whole(y) + 1.0) for x, y in quads]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost each feature's table in turn, ROUNDS times; then choose PAIRS pairs by gain and boost theirs."""
    d = x.shape[1]
    edges = [_edges(x[:, j], BINS) for j in range(d)]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    tables = np.zeros((d, BINS + 1))
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(edges, coarse, float(np.log(share / (1 - share))), tables, [], np.zeros((0, PAIR_BINS + 1, PAIR_BINS + 1)))
    if len(y) < 2 or y.min() == y.max():
        return model
    total = np.full(len(y), model.intercept)
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(edges[j]) + 1
            step = RATE * _shallow(np.bincount(at[j], g, n), np.bincount(at[j], h, n))
            tables[j, :n] += step
            total += step[at[j]]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    side = PAIR_BINS + 1
    flat = lambda i, j: small[i] * side + small[j]
    g, h = slopes()
    grid = lambda w, i, j: np.bincount(flat(i, j), w, side * side).reshape(side, side)
    ranked = sorted(((_quadrants(grid(g, i, j), grid(h, i, j))[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), side, side))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(g, i, j), grid(h, i, j))[1]
            model.pair_tables[k] += step
            total += step.ravel()[flat(i, j)]
    return model


def held_out(doc_id: str) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def one_text_each(labelled: DataFrame) -> DataFrame:
    """(text, y), one row for each doc_id of (doc_id, text, y)."""
    least = F.min(F.struct(F.xxhash64("text"), "text", "y")).alias("least")
    return labelled.groupBy("doc_id").agg(least).select("least.text", "least.y")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on up to `rows` labelled documents that aren't held out; what reaches the driver has that bound.

    Rows with a null label, id or text are not learned from; of several labels for one id, the least counts; of several
    texts, that of the least hash, then the least. So the sample is the same on each run.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    # at most `rows` ids and marks, so that the texts need no shuffle to meet them
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in x.T]], names=["y", *FEATURES])

    own = one_text_each(own.join(known, "doc_id"))
    sample = own.mapInArrow(run, "y int, " + ", ".join(f"{c} double" for c in FEATURES))
    table = sample.toArrow()
    x = np.stack([table.column(c).to_numpy() for c in FEATURES], axis=1)
    y = table.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the order of partitions does not matter
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with held_out (boolean), score (double, 0 to 1, higher: label 1 likelier) and predicted (int).

    Only the text enters a score. Null, empty and blank texts are scored as a text without words. Null id: not held
    out. No or one-sided labels: every score is the labels' smoothed share. Repeated rows: equal scores. Empty table:
    empty result. Columns named like the new ones are replaced.
    """
    model = train(docs, labels, text, doc_id)
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    out = docs.select(*keep, held_out(doc_id).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to have label 1, with the columns of docs."""
    return score_quality(docs, labels).where("predicted = 1").select(*docs.columns)
