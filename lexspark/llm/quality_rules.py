"""Quality rules under weak supervision: rules vote or abstain, EM estimates how right each is, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm import textkit
from lexspark.session import cut

#: Base rules: fewest words, and the highest percentage of words in repeated windows of WINDOW words.
LEAST_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: A document is kept at this posterior probability of good quality, if the base rules hold.
KEEP = 0.5
#: Prior share of bad documents; of a rule's votes on bad and good documents, before any document is seen (low, none, high).
BAD_SHARE = 0.15
PRIOR_VOTES = {"bad": (0.3, 0.5, 0.2), "good": (0.01, 0.59, 0.4)}
#: Weight of these priors, as a share of all documents.
PRIOR_WEIGHT = 0.05
ROUNDS, SETTLED = 500, 1e-10

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_lines", "n_letters", "n_capitals", "n_plain_words", "n_punctuation", "n_exclaims", "n_short_words")
_NEW = (*MEASURES, *_EXTRA, "votes", "posterior", "base_failed", "kept")

_ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name to (votes bad, votes good), two conditions on what is measured of a text, of which one holds at most."""
    length, symbols, repeated = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words")
    copied, capitals = _ratio("n_dup_lines", "n_lines"), _ratio("n_capitals", "n_letters")
    plain, exclaims, marks = _ratio("n_plain_words", "n_words"), _ratio("n_exclaims", "n_words"), _ratio("n_punctuation", "n_words")
    short, some, never = _ratio("n_short_words", "n_words"), F.col("n_words") >= 20, F.lit(False)
    # a fault found is a vote; that none is found is none, so that many kinds of fault don't outvote the one that is there
    return {
        "word count": (F.col("n_words") < LEAST_WORDS, never),
        "word length": ((F.col("n_words") > 0) & ~length.between(2.5, 12), never),
        "symbols": (symbols > 0.1, never),
        "repeated lines": (copied > 0.3, never),
        "repeated words": (repeated > 0.2, never),
        "capitals": (capitals > 0.3, never),
        "plain words": (plain < 0.6, never),
        "exclamations": (exclaims > 0.2, never),
        "punctuation": (some & ~marks.between(0.01, 0.8), some & marks.between(0.03, 0.5)),
        "short words": (some & (short < 0.05), some & short.between(0.15, 0.7)),
    }


# --- measures of texts


def _mask(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(text.encode(), np.uint8)] = True
    return out


_CASED = textkit.exact_table()
_CLASSES = {
    "n_symbols": _mask("#*$%&|<>"), "n_letters": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "n_capitals": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_punctuation": _mask(".,;:?"), "n_exclaims": _mask("!"),
}
#: Bytes that a plain word doesn't have: other than letters, digits, bytes of non-ASCII letters and what stands beside words.
_ODD = ~(_CLASSES["n_letters"] | _mask("0123456789.,;:?'\"()-") | (np.arange(256) >= 128))
_FEED = _mask("\n")


def _total(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _in_repeats(words: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = textkit.shingle_hashes(words, WINDOW)
    _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[which] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(again)] += again
    edge[WINDOW : WINDOW + len(again)] -= again
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES and what else the rules ask, a number for each text; windows and lines are compared by 64-bit hashes."""
    done: dict[str, list] = {name: [] for name in (*MEASURES, *_EXTRA)}
    for _, _, data, offsets in textkit.blocks(texts):
        space = textkit.SPACES[data]
        starts, ends, first = textkit.spans(space, offsets)
        sums = textkit.prefix_sums(data, _CASED)
        words = textkit.span_hashes(data, starts, ends, sums=sums)
        odd = _total(_ODD[data])
        chars = _total(~space & ((data & 0xC0) != 0x80))
        own = {
            "n_words": np.diff(first),
            "word_chars": np.diff(chars[offsets]),
            "n_short_words": np.diff(_total(chars[ends] - chars[starts] <= 3)[first]),
            "n_plain_words": np.diff(_total(odd[ends] == odd[starts])[first]),
            **{name: np.diff(_total(which[data])[offsets]) for name, which in _CLASSES.items()},
        }
        lines, line_ends, first_line = textkit.spans(_FEED[data], offsets)
        # lines with a word: empty ones have no run, blank ones no byte of a word
        inside = _total(~space)
        real = inside[line_ends] > inside[lines]
        line_hash = textkit.span_hashes(data, lines, line_ends, sums=sums)
        own["n_lines"] = np.diff(_total(real)[first_line])
        own["n_dup_lines"] = np.array(
            [int(k) - len(np.unique(line_hash[a:b][real[a:b]])) for k, a, b in zip(own["n_lines"], first_line[:-1], first_line[1:], strict=True)], np.int64
        )
        own["n_repeat_words"] = np.array([_in_repeats(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
        for name, values in own.items():
            done[name].append(values)
    return {name: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for name, v in done.items()}


# --- votes and their model


@dataclass
class Votes:
    """share: of bad documents; tables: [rule, 0 bad or 1 good, 0 low, 1 none or 2 high vote], each row of three adds up to 1."""

    share: float
    tables: np.ndarray

    def accuracies(self) -> np.ndarray:
        """Of each rule, the share of its votes on bad and on good documents that are right."""
        low, high = self.tables[:, :, 0], self.tables[:, :, 2]
        voted = np.maximum(low + high, 1e-300)
        return np.stack([(low / voted)[:, 0], (high / voted)[:, 1]], axis=1)

    def log_odds(self) -> tuple[float, np.ndarray]:
        """Of good against bad: what holds before any vote, and what each rule's vote adds."""
        return float(np.log((1 - self.share) / self.share)), np.log(self.tables[:, 1] / self.tables[:, 0])


def fit(votes: np.ndarray, counts: np.ndarray) -> Votes:
    """Expectation-maximisation over distinct rows of votes (0 low, 1 none, 2 high), each counts times.

    Each rule has a table of votes for bad and one for good documents; given the quality, rules vote independently.
    The priors count as PRIOR_WEIGHT of all documents, so that the result doesn't depend on how many there are, and
    keep the two classes from changing places.
    """
    n_rules = votes.shape[1]
    prior = np.tile(np.array([PRIOR_VOTES["bad"], PRIOR_VOTES["good"]]), (n_rules, 1, 1))
    total = counts.sum()
    if not total:
        return Votes(BAD_SHARE, prior)
    weight = np.array([BAD_SHARE, 1 - BAD_SHARE]) * PRIOR_WEIGHT * total
    hot = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    model = Votes(BAD_SHARE, prior)
    for _ in range(ROUNDS):
        bad = 1 - posterior(model, votes)
        mass = np.stack([bad, 1 - bad]) * counts
        seen = np.einsum("cp,prv->rcv", mass, hot) + prior * weight[None, :, None]
        tables = seen / seen.sum(axis=2, keepdims=True)
        share = float((mass[0].sum() + weight[0]) / (total + weight.sum()))
        moved = max(abs(share - model.share), float(np.abs(tables - model.tables).max()))
        model = Votes(share, tables)
        if moved < SETTLED:
            break
    return model


def posterior(model: Votes, votes: np.ndarray) -> np.ndarray:
    """Probability of good quality for each row of votes."""
    start, parts = model.log_odds()
    total = start + parts[np.arange(votes.shape[1]), votes].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _votes() -> Column:
    return F.array(*[F.when(bad, 0).when(good, 2).otherwise(1) for bad, good in rules().values()])


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (its columns `carry`; None: all) with MEASURES, votes, posterior, base_failed and kept.

    Words are runs of other than space and \\t to \\r. word_chars: code points in words; n_symbols: characters # * $ % &
    | < >; n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words in windows of five words that
    occur twice or more. base_failed: under 10 words, or over 20 % of them repeated. Each of rules() votes low or high or
    abstains; posterior is the probability of good quality by a model of their votes that is fitted, without labels, on
    how often each combination of votes occurs over all documents (3 ** rules at most reach the driver, however many
    documents there are). kept: not base_failed, and posterior >= 0.5. Null, empty and blank texts have no words and fail
    the base. Repeated rows: equal verdicts, each counted. Empty table: empty result. Columns named like the new ones are
    replaced.
    """
    names = docs.columns if carry is None else carry
    keep = [c for c in names if c.lower() not in _NEW]
    fields = (*MEASURES, *_EXTRA)

    @F.arrow_udf(", ".join(f"{name} long" for name in fields))
    def measured(texts: pa.Array) -> pa.Array:
        found = measure(texts)
        return pa.StructArray.from_arrays([pa.array(found[name]) for name in fields], names=list(fields))

    rows = docs.select(*keep, measured(F.coalesce(F.col(text), F.lit(""))).alias("__m"))
    rows = cut(rows.select(*keep, *[F.col(f"__m.{name}").alias(name) for name in fields]), "measures", "zstd")
    rows = rows.withColumn("votes", _votes())
    seen = rows.groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    order = np.lexsort(np.array(seen["votes"].tolist()).T[::-1]) if len(seen) else []
    table = np.array(seen["votes"].tolist(), int).reshape(len(seen), len(rules()))[order]
    model = fit(table, seen["n"].to_numpy(float)[order])
    start, parts = model.log_odds()
    odds = sum((F.get(F.array(*[F.lit(float(x)) for x in part]), F.col("votes")[i]) for i, part in enumerate(parts)), F.lit(start))
    rows = rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= KEEP))
    return rows.select(*keep, *MEASURES, "votes", "posterior", "base_failed", "kept")


def drop_bad(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    return judge(docs).where("kept").select(*[c for c in docs.columns if c.lower() not in _NEW])
