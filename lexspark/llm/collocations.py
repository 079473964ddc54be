"""Phrase collocations by compressed position bitmaps: shift, AND and popcount extend phrases; popcounts add up over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.llm import textkit
from lexspark.operators.numbering import numbered_as_written
from lexspark.session import cut

#: Fewest uses of a candidate phrase, and most phrases of a language that are returned.
LEAST, TOP = 10, 2000
#: A candidate goes if a longer one around it has this share (percent) of its uses.
ABSORBED = 50
SCALE = 1_000_000
#: Frequent words up to which the key of a pair fits in 64 bits.
MOST_WORDS = 3_000_000_000
#: UTF-8 bytes of text that one shard holds; a single longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Most products of a prefix's and a word's bitmap bytes that are worked out together.
CHUNK = 1 << 19

_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_GAPS = _PIECE_ENDS.copy()
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SHARD_SCHEMA = "lang string, shard long, place int, word string, n long, bits binary"
_SHARD_ARROW = pa.schema(
    [("lang", pa.string()), ("shard", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("bits", pa.binary())]
)


# --- one shard: texts to bitmaps, and back


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each word in its place, and whether a piece starts there; in the order of the texts."""
    data, offsets = textkit.buffers(texts)
    data, offsets = _LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    starts, ends, first = textkit.spans(_GAPS[data], offsets)
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, bool)
    ended = np.cumsum(_PIECE_ENDS[data], dtype=np.int32)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = ended[1:] != ended[:-1]
    opens[first[:-1][first[:-1] < first[1:]]] = True
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    run = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~_GAPS[data]])])
    coded = run.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), opens


def pack(words: np.ndarray, opens: np.ndarray, n_words: int) -> bytes:
    """Bitmaps of positions, one for each word: its bytes that aren't zero, as steps between them; then where pieces start."""
    at = np.arange(len(words), dtype=np.int64)
    order = np.argsort(words, kind="stable")
    word, block, bit = words[order].astype(np.int64), at[order] >> 3, (1 << (at[order] & 7)).astype(np.uint8)
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
    heads = np.flatnonzero(fresh)
    masks = np.bitwise_or.reduceat(bit, heads) if len(heads) else bit
    word, block = word[heads], block[heads]
    steps = np.diff(block, prepend=0)
    steps[1:][word[1:] != word[:-1]] = block[1:][word[1:] != word[:-1]]
    sizes = np.bincount(word, minlength=n_words).astype(np.uint32)
    head = np.array([len(words), n_words, len(masks)], np.int64)
    return pa.compress(
        b"".join(x.tobytes() for x in (head, sizes, steps.astype(np.uint32), masks, np.packbits(opens, bitorder="little"))), "zstd", asbytes=True
    ) + np.array([24 + 4 * n_words + 5 * len(masks) + (len(opens) + 7) // 8], np.int64).tobytes()


def unpack(bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, mask) of each byte that isn't zero, by word, then block; and the bitmap of places where no piece starts."""
    raw = np.frombuffer(pa.decompress(bits[:-8], int(np.frombuffer(bits[-8:], np.int64)[0]), "zstd", asbytes=True), np.uint8)
    n, n_words, n_masks = (int(x) for x in raw[:24].view(np.int64))
    sizes = raw[24 : 24 + 4 * n_words].view(np.uint32).astype(np.int64)
    at = 24 + 4 * n_words
    steps = raw[at : at + 4 * n_masks].view(np.uint32).astype(np.int64)
    masks = raw[at + 4 * n_masks : at + 5 * n_masks]
    word = np.repeat(np.arange(n_words), sizes)
    total = np.cumsum(steps)
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], total])[ends - sizes]
    block = total - np.repeat(before, sizes)
    inside = np.zeros(n // 8 + 2, np.uint8)
    inside[: (n + 7) // 8] = ~raw[at + 5 * n_masks :]
    return word, block, masks, inside


class Bitmaps:
    """The bitmaps of a shard's words that matter, by word and by block."""

    def __init__(self, bits: bytes, places: np.ndarray, ids: np.ndarray):
        word, block, mask, self.inside = unpack(bits)
        known = np.full(int(word.max()) + 1 if len(word) else 1, -1)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        known[places[order]] = np.arange(len(order))
        own = known[word]
        keep = own >= 0
        order = np.argsort(own[keep], kind="stable")
        self.word, self.block, self.mask = own[keep][order], block[keep][order], mask[keep][order]
        by = np.argsort(self.block, kind="stable")
        self.there, self.there_mask = self.word[by], self.mask[by]
        self.first = np.searchsorted(self.block[by], np.arange(len(self.inside) + 1))

    def extend(self, prefix: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(prefix, word, block, mask) that aren't zero, for each word behind each prefix in its piece: (prefix << 1) AND word.

        prefix is sorted; all of one prefix comes in one turn.
        """
        over = mask >> 7 & self.inside[block + 1] & 1
        here = (mask << 1) & self.inside[block]
        prefix, block, mask = (np.concatenate([a[here != 0], b[over != 0]]) for a, b in ((prefix, prefix), (block, block + 1), (here, over)))
        order = np.argsort(prefix, kind="stable")
        prefix, block, mask = prefix[order], block[order], mask[order]
        size = self.first[block + 1] - self.first[block]
        done = np.cumsum(size)
        a = 0
        while a < len(prefix):
            b = int(np.searchsorted(done, (done[a - 1] if a else 0) + CHUNK, "right"))
            b = int(np.searchsorted(prefix, prefix[min(max(b, a + 1), len(prefix)) - 1], "right"))
            n = size[a:b]
            row = np.repeat(np.arange(a, b), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[block[row]]
            both = mask[row] & self.there_mask[at]
            hit = np.flatnonzero(both)
            yield prefix[row[hit]], self.there[at[hit]], block[row[hit]], both[hit]
            a = b

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word's id, second's, popcount)."""
        for first, second, _, mask in self.extend(self.word, self.block, self.mask):
            key, n = _added(first * len(self.ids) + second, mask)
            yield self.ids[key // len(self.ids)], self.ids[key % len(self.ids)], n

    def triples(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(ids of three words, popcount), both of whose pairs are among the given ones."""
        size = len(self.ids)
        good = np.unique(np.searchsorted(self.ids, one) * size + np.searchsorted(self.ids, two))

        def given(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(good, key), len(good) - 1)
            return at, good[at] == key

        if not len(good):
            return
        for first, second, block, mask in self.extend(self.word, self.block, self.mask):
            at, ok = given(first * size + second)
            at, block, mask = at[ok], block[ok], mask[ok]
            order = np.argsort(at, kind="stable")
            for pair, third, _, rest in self.extend(at[order], block[order], mask[order]):
                ok = given(good[pair] % size * size + third)[1]
                key, n = _added(pair[ok] * size + third[ok], rest[ok])
                pair, third = good[key // size], key % size
                yield self.ids[pair // size], self.ids[pair % size], self.ids[third], n


def _added(keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, and the bits set in its masks."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.bitwise_count(masks[order]).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(n, heads) if len(heads) else n


# --- over shards


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def flush(lang: str) -> pa.RecordBatch | None:
        nonlocal shard
        words, coded, opens = words_of(pa.concat_arrays(held.pop(lang)))
        size.pop(lang)
        n = len(words)
        if not n:
            return None
        shard += 1
        counts = np.append(np.bincount(coded, minlength=n), len(coded))
        columns = [
            pa.array([lang] * (n + 1), pa.string()), pa.array(np.full(n + 1, shard)), pa.array(np.arange(n + 1, dtype=np.int32)),
            pa.concat_arrays([words.cast(pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(counts),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([pack(coded, opens, n)], pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_SHARD_ARROW)

    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        for lang in pc.unique(langs).to_pylist():
            own = texts.filter(pc.equal(langs, lang))
            held.setdefault(lang, []).append(own)
            size[lang] = size.get(lang, 0) + own.nbytes
            if size[lang] >= SHARD_BYTES and (out := flush(lang)) is not None:
                yield out
        while sum(size.values()) > 2 * SHARD_BYTES:
            if (out := flush(max(size, key=size.get))) is not None:
                yield out
    for lang in list(held):
        if (out := flush(lang)) is not None:
            yield out


def _bitmaps(group: pa.Table) -> Bitmaps:
    at = group.filter(pc.equal(group["kind"], 1))
    bits = group.filter(pc.equal(group["kind"], 0))["bits"][0].as_py()
    return Bitmaps(bits, at["x"].to_numpy(), at["y"].to_numpy())


def _joined(parts: list[tuple], width: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * width


def _pairs(size: int):
    """A shard's pairs (key, n), key being the first word's id times `size` plus the second's."""

    def run(group: pa.Table) -> pa.Table:
        one, two, n = _joined(list(_bitmaps(group).pairs()), 3)
        return pa.table({"shard": np.full(len(n), group["shard"][0].as_py()), "key": one * size + two, "n": n})

    return run


def _triples(size: int):
    """A shard's triples (key of the first two words, id of the third, n) of its frequent pairs."""

    def run(group: pa.Table) -> pa.Table:
        given = group.filter(pc.equal(group["kind"], 2))["x"].to_numpy()
        one, two, three, n = _joined(list(_bitmaps(group).triples(given // size, given % size)), 4)
        return pa.table({"key": one * size + two, "w3": three, "n": n})

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, id, f), pairs (w1, w2, a) and triples (w1, w2, w3, a) used `least` times or more, and (lang, n).

    Texts of a language are laid one after another in shards of bounded size. A shard has, for each of its words, the
    compressed bitmap of the places where it stands, and one of the places where a piece starts. A phrase's bitmap,
    shifted by one place, without the places where a piece starts, and that of a next word give the longer phrase's.
    Within a shard phrases are extended depth-first, for some prefixes at a time; between lengths the popcounts are
    added over all shards, so that only phrases that are frequent in all documents are extended. Only counts of a
    shard's different pairs and frequent pairs' triples are shuffled, and each shard's bitmaps once for each length.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = cut(rows.mapInArrow(_shard, SHARD_SCHEMA), "shards")
    totals = shards.where("bits is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    local = shards.where("bits is null")
    words = numbered_as_written(local.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    words = cut(words, "words")
    size = max(1, words.count())
    if size >= MOST_WORDS:
        raise OverflowError(f"{size} frequent words: a pair's key would pass 64 bits")
    placed = local.select("lang", "word", "shard", "place").join(words.select("lang", "word", "id"), ["lang", "word"])
    placed = cut(placed.select("shard", "place", "id"), "placed")
    none = F.lit(None).cast("binary").alias("bits")
    kind = lambda k: F.lit(k).alias("kind")
    zero = F.lit(0).cast("long")
    bits = shards.where("bits is not null").join(placed.select("shard").distinct(), "shard", "left_semi")
    bits = bits.select("shard", kind(0), zero.alias("x"), zero.alias("y"), "bits")
    base = bits.union(placed.select("shard", kind(1), F.col("place").cast("long").alias("x"), F.col("id").alias("y"), none))
    # a pair has one row at most for each shard, so that no pair holds more than a shard's share of the rows
    found = base.groupBy("shard").applyInArrow(_pairs(size), "shard long, key long, n long")
    found = found.withColumn("a", F.sum("n").over(W.partitionBy("key"))).where(F.col("a") >= least)
    found = cut(found.select("shard", "key", "a"), "pairs")
    again = base.join(found.select("shard").distinct(), "shard", "left_semi")
    again = again.union(found.select("shard", kind(2), F.col("key").alias("x"), zero.alias("y"), none))
    triples = again.groupBy("shard").applyInArrow(_triples(size), "key long, w3 long, n long")
    triples = triples.groupBy("key", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    pair = [F.expr(f"key div {size}").alias("w1"), F.expr(f"key % {size}").alias("w2")]
    pairs = cut(found.groupBy("key").agg(F.max("a").alias("a")).select(*pair, "a"), "pairs")
    return words, pairs, cut(triples.select(*pair, "w3", "a"), "triples"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three words.

    Texts are lower-cased in A-Z and split at . , ; : ! ? and \\n to \\r into pieces, those at spaces and tabs into
    words. Everything is by language (null: und): n is the number of words, f(phrase) that of its uses within pieces,
    overlapping ones included. A candidate has a = f >= least. A cut behind its first k words, with l = f(first part)
    and r = f(rest), scores floor(1000000 * a * a / (l * r)), in whole numbers of up to 38 digits; the lowest cut
    counts, then the smallest k. A pair inside a triple of half its uses or more goes. Ranked by score, a, then phrase
    in the order of its UTF-8 bytes. Null, empty and blank texts have no words; rows that repeat count again; a
    language without candidates, and an empty table, have no rows; other columns don't matter.
    """
    words, pairs, triples, totals = phrase_counts(docs, text, lang, least)
    first = words.select(F.col("id").alias("w1"), F.col("f").alias("f1"), F.col("word").alias("t1"), "lang")
    one = lambda n: words.select(F.col("id").alias(f"w{n}"), F.col("f").alias(f"f{n}"), F.col("word").alias(f"t{n}"))
    inner = triples.select("w1", "w2", "a").union(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inner = inner.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    left = pairs.join(inner, ["w1", "w2"], "left").where(f"longer is null or 100 * longer < {ABSORBED} * a")
    two = left.join(first, "w1").join(one(2), "w2")
    two = two.select("lang", "a", F.concat_ws(" ", "t1", "t2").alias("phrase"), _cut("f1", "f2", 1).alias("c"))
    head = pairs.select("w1", "w2", F.col("a").alias("head"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"))
    three = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(first, "w1").join(one(2), "w2").join(one(3), "w3")
    least_cut = F.least(_cut("f1", "tail", 1), _cut("head", "f3", 2))
    three = three.select("lang", "a", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), least_cut.alias("c"))
    scored = two.union(three).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(left: str, right: str, k: int) -> Column:
    """score, k, l and r of a cut behind the first k words."""
    score = F.expr(f"(CAST(a AS DECIMAL(15)) * CAST(a AS DECIMAL(15)) * CAST({SCALE} AS DECIMAL(7))) div (CAST({left} AS DECIMAL(15)) * CAST({right} AS DECIMAL(15)))")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
