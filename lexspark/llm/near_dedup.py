"""Near-duplicate documents by b-bit MinHash: bands give candidates, packed low bits an estimate, full sets the proof."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm import textkit
from lexspark.llm.graph import components
from lexspark.session import cut

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
#: A pair at a similarity of 0.75 shares no band with a probability of (1 - 0.75**5)**40 = 2e-5.
BANDS, ROWS = 40, 5
#: Minima whose low bits are kept; the first BANDS * ROWS of them make the bands.
SIGNED = 400
#: Low bits kept of each.
BITS = 4
#: Candidates go on from this many standard deviations below the similarity asked for: 3e-5 of pairs just at it do not.
SLACK = 4.0
#: Documents, and shingles of theirs, of one bucket that are compared at once, on either side.
CHUNK, CHUNK_SHINGLES = 256, 200_000
#: Candidates that a document takes from the buckets held apart in the first round; four times as many in the next.
TAKEN = 4
ROUNDS = 1

_PER_LONG = 64 // BITS


def sketcher(bands: int, rows: int, k: int):
    """A mapInArrow function: (doc_id, text) to (doc_id, n_shingles, h1, h2, bands, sig)."""
    n, banded = max(SIGNED, bands * rows), bands * rows
    rng = np.random.Generator(np.random.PCG64(75))
    a = rng.integers(0, 2**31, n, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    c = rng.integers(0, 2**31, n, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    weights = textkit.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = textkit.mix(np.arange(1000, 1000 + bands, dtype=np.uint64))
    longs, per_long, bits = -(-n // _PER_LONG), _PER_LONG, BITS

    def minima(values: np.ndarray) -> np.ndarray:
        high, low = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
        out = None
        for at in range(0, len(values), 2048):
            part = (a * high[at : at + 2048] + c * low[at : at + 2048]).min(axis=1)
            out = part if out is None else np.minimum(out, part)
        return textkit.mix(out.astype(np.uint64) + np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            sigs = np.zeros((batch.num_rows, longs), np.uint64)
            sizes = np.zeros(batch.num_rows, np.int64)
            ids = np.zeros((batch.num_rows, 2), np.uint64)
            for i, values in enumerate(textkit.shingle_sets(batch.column(1), k)):
                sizes[i] = len(values)
                if len(values):
                    ids[i] = np.frombuffer(hashlib.blake2b(values, digest_size=16).digest(), np.uint64)
                    m = minima(values)
                    keys[i] = textkit.mix((m[:banded].reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + salt)
                    low = np.zeros(longs * per_long, np.uint64)
                    low[:n] = m & np.uint64(2**bits - 1)
                    low = low.reshape(longs, per_long) << (np.arange(per_long, dtype=np.uint64) * np.uint64(bits))
                    sigs[i] = np.bitwise_or.reduce(low, axis=1)
            lists = lambda x: pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(ids[:, 0].copy().view(np.int64)),
                 pa.array(ids[:, 1].copy().view(np.int64)), lists(keys), lists(sigs)],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
            )

    return run


def set_maker(k: int):
    """A mapInArrow function: (doc_id, text) to (doc_id, members), the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, sizes, first = [], [0], 0
            for i, values in enumerate(textkit.shingle_sets(batch.column(1), k)):
                done.append(values.view(np.int64))
                sizes.append(sizes[-1] + len(values))
                if sizes[-1] > 500_000 or i == batch.num_rows - 1:
                    members = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(done)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, i + 1 - first), members], names=["doc_id", "members"]
                    )
                    done, sizes, first = [], [0], i + 1

    return run


def estimate(a: Column, b: Column, n: int = SIGNED) -> Column:
    """Similarity by equal b-bit values, corrected for those equal by chance (a share of 2**-b)."""
    ones = (1 << 64) // (2**BITS - 1)  # the lowest bit of each packed value
    mask = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)

    def differing(i: int) -> Column:
        x = unequal = a[i].bitwiseXOR(b[i])
        for step in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(unequal, step))
        return F.bit_count(x.bitwiseAND(mask))

    equal = F.lit(float(n)) - sum((differing(i) for i in range(1, -(-n // _PER_LONG))), differing(0))
    chance = 2.0**-BITS
    return (equal / F.lit(float(n)) - F.lit(chance)) / F.lit(1 - chance)


def floor_of(percent: int, n: int = SIGNED) -> float:
    """The estimate from which a pair is compared in full: SLACK standard deviations below."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - SLACK * math.sqrt(equal * (1 - equal) / n) / (1 - chance)


def sets_of(wanted: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, members): the sets of the wanted documents."""
    own = texts.join(cut(wanted, "wanted"), "doc_id", "left_semi").select("doc_id", "text")
    return cut(textkit.map_arrow(own, set_maker(k), "doc_id long, members array<long>"), "sets")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = sets_of(wanted, texts, k)
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a").cast("long") + F.size("set_b").cast("long") - F.col("both")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("both", both)
        .where(F.lit(100) * F.col("both") >= F.lit(percent) * union)
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    k: int = SHINGLE_WORDS,
    percent: int = SIMILARITY_PERCENT,
) -> DataFrame:
    """docs with n_shingles (long), component_id (long) and kept (boolean).

    A document's set has its distinct k-word shingles (see textkit.shingle_sets); documents are linked at
    100 * intersection >= percent * union; component_id is the smallest id reachable, and kept is
    doc_id = component_id. Rows of one id count as one document: they share a component, and n_shingles is that of
    the largest set (rows without an id: likewise). Null, empty or blank text: an empty set, linked with nothing.
    Null id: component_id null, linked with nothing, kept. Columns of docs named like the new ones are replaced.
    Empty table: empty result.

    Documents of equal sets, told by 128 bits of a cryptographic digest of the whole set, form a class, and its
    smallest id stands for it. Of each class, ROWS minima form the key of each of BANDS bands. First each class meets
    the centre of its buckets, that of its fellows that shares most buckets with others. What the buckets then still
    hold apart is settled in rounds (see settled). Pairs whose estimate is high enough are proved on the full sets of
    64-bit shingle hashes. No bucket is capped.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = cut(
        textkit.map_arrow(
            own,
            sketcher(BANDS, ROWS, k),
            "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig array<long>",
        ),
        "sketch",
    )
    usable = sketch.where("doc_id is not null and n_shingles > 0")
    classes = cut(
        usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    # links of equal sets: each document to its class's smallest id
    shared = classes.where("copies > 1").drop("copies")
    copies = usable.select("doc_id", "h1", "h2", "n_shingles").join(shared, ["h1", "h2", "n_shingles"])
    copies = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # one row for each class
    unique = usable.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "sig", "bands")
    signs = unique.select("doc_id", "sig")
    members = unique.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1"), "buckets")
    in_bucket = cut(members.join(buckets, "key"), "in-bucket")
    floor = floor_of(percent)
    # first each member with the centre of its buckets, the class that shares most buckets with others
    degree = in_bucket.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    centred = in_bucket.select("key", "doc_id").join(cut(degree, "degree"), "doc_id")
    centres = centred.groupBy("key").agg(F.max(F.struct("degree", F.col("doc_id").alias("id"))).alias("centre"))
    first = (
        in_bucket.select("key", "doc_id")
        .join(cut(centres, "centres"), "key")
        .groupBy("doc_id")
        .agg(F.max("centre").alias("centre"))
        .where("centre.id <> doc_id")
        .select(F.least("doc_id", "centre.id").alias("a"), F.greatest("doc_id", "centre.id").alias("b"))
        .distinct()
    )
    likely = (
        first.join(signs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(signs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        .where(estimate(F.col("sig_a"), F.col("sig_b")) >= floor)
        .select("a", "b")
    )
    links = cut(verified(cut(likely, "likely"), own, k, percent), "links")
    found = cut(components(links.union(copies)), "components")
    found = settled(in_bucket, found, unique, own, floor, k, percent)

    sizes = sketch.select("doc_id", "n_shingles")
    names = {c.lower() for c in ("n_shingles", "component_id", "kept")}
    plain = docs.select(*[c for c in docs.columns if c.lower() not in names])
    sizes = sizes.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    joined = plain.join(
        sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            F.col("doc_id").alias("__id"),
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
        ),
        F.col(doc_id).cast("long").eqNullSafe(F.col("__id")),
        "left",
    ).drop("__id")
    return joined.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))


def settled(in_bucket: DataFrame, found: DataFrame, unique: DataFrame, texts: DataFrame, floor: float, k: int, percent: int) -> DataFrame:
    """(node, component) once every pair that shares a bucket is in one component, below the floor or disproved.

    in_bucket: key, band, doc_id; found: node, component so far; unique: doc_id, sig, bands, n_shingles. The members
    outside the component of a bucket's anchor (a member of its largest component) meet all members of the bucket in
    chunks. In ROUNDS rounds each takes its likeliest candidates of other components, one from each of TAKEN hash
    classes (more in each next round); these are proved and the components contracted, so that most of what belongs
    together is joined by few proofs. A member that finds no candidate is done. Chunks of the buckets that the others
    are in then bring their full sets along, and what they still have is proved where it is found: only true links come
    out, so that all rows are in proportion to members, none to pairs.
    """

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(found.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    parts = labelled(in_bucket.select("key", "doc_id"), "doc_id", "component")
    parts = parts.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    parts = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", F.col("low").alias("anchor"))).alias("most"))
    mixed = cut(parts.where("parts > 1").select("key", F.col("most.anchor").alias("anchor")), "mixed")
    rows = cut(in_bucket.select("key", "band", "doc_id").join(mixed, "key"), "mixed-rows")
    active = None
    for turn in range(ROUNDS + 1):
        state = labelled(labelled(rows, "doc_id", "component"), "anchor", "main")
        state = state.withColumn("outside", F.col("component") != F.col("main"))
        if active is not None:
            state = state.join(active, "doc_id", "left").withColumn("outside", F.col("outside") & F.coalesce("active", F.lit(False)))
        state = cut(state.select("key", "band", "doc_id", "component", "outside"), "state")
        held = cut(state.where("outside").select("key").distinct(), "held-apart")
        full = state.join(held, "key").join(unique, "doc_id")
        columns, last = ["doc_id", "component", "sig"], turn == ROUNDS
        if last:
            full = full.join(sets_of(full.select("doc_id").distinct(), texts, k), "doc_id")
            columns += ["bands", "members"]
        full = cut(full.select("key", "band", "outside", "n_shingles", *columns), "held-apart-rows")
        # chunks hold about CHUNK documents, and CHUNK_SHINGLES where they bring their sets
        weight = F.lit(1.0 / CHUNK) + (F.col("n_shingles") / CHUNK_SHINGLES if last else F.lit(0.0))
        sizes = full.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("outside"), weight))).alias("of_left"), F.ceil(F.sum(weight)).alias("of_right"))
        full = full.join(cut(sizes, "chunks"), "key")
        part = lambda size: F.pmod(F.xxhash64("doc_id"), F.col(size)).alias("part")
        left = full.where("outside").groupBy("key", "band", "of_right", part("of_left")).agg(F.collect_list(F.struct(*columns)).alias("left")).drop("part")
        left = left.select("key", "band", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_right") - 1)).alias("part"))
        right = full.groupBy("key", part("of_right")).agg(F.collect_list(F.struct(*columns)).alias("right"))
        both = left.join(right, ["key", "part"]).select("left", "right", "band")
        if last:
            links = both.mapInArrow(prover(floor, percent), "a long, b long").distinct()
        else:
            near = both.mapInArrow(nearest(floor, TAKEN << 2 * turn), "a long, class long, equal long, b long")
            near = near.groupBy("a", "class").agg(F.max(F.struct("equal", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
            near = cut(near, "nearest")
            if near.isEmpty():
                return found
            active = near.select(F.col("a").alias("doc_id"), F.lit(True).alias("active")).distinct()
            pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            links = verified(cut(pairs, "candidates"), texts, k, percent)
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(cut(links, "links"))
        found = cut(components(edges), "components")
    return found


def _meetings(batch: pa.RecordBatch, floor: float) -> Iterator[tuple]:
    """Of each row's two lists: their columns, and for each member of the left one the places in the right one that are
    near enough and of another component, with the numbers of equal values."""
    bits, n, chance = BITS, SIGNED, 2.0**-BITS
    ones = np.uint64((1 << 64) // (2**bits - 1))
    least = math.ceil(n * (chance + (1 - chance) * floor) - 1e-9)
    for i in range(batch.num_rows):
        x, y = ({f.name: values.field(f.name) for f in values.type} for values in (batch.column(c)[i].values for c in (0, 1)))
        parts, others = (np.asarray(z["component"]) for z in (x, y))
        sigs, other_sigs = (_rows_of(z["sig"]).view(np.uint64) for z in (x, y))
        for at in range(len(parts)):
            folded = diff = sigs[at][None, :] ^ other_sigs
            for step in range(1, bits):
                folded = folded | (diff >> np.uint64(step))
            equal = n - np.bitwise_count(folded & ones).sum(axis=1, dtype=np.int64)
            good = np.flatnonzero((equal >= least) & (others != parts[at]))
            if len(good):
                yield i, x, y, at, good, equal[good]


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def nearest(floor: float, classes: int):
    """A mapInArrow function: two lists of members to the likeliest b of another component for each a and hash class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: list[np.ndarray] = []
            for _, x, y, at, good, equal in _meetings(batch, floor):
                others = np.asarray(y["doc_id"])[good]
                kind = (textkit.mix(others.astype(np.uint64)) % np.uint64(classes)).astype(np.int64)
                order = np.lexsort((others, equal, kind))
                order = order[np.append(kind[order][1:] != kind[order][:-1], True)]  # the last of each class
                best.append(np.stack([np.full(len(order), x["doc_id"][at].as_py()), kind[order], equal[order], others[order]]))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(best, axis=1)], names=["a", "class", "equal", "b"])

    return run


def prover(floor: float, percent: int):
    """A mapInArrow function: two lists of members with their sets, and their band, to the true links between them.

    One link of each a to each other component is enough. A pair is looked at in its first common band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            row, known, bands, other_bands = -1, {}, None, None
            for i, x, y, at, good, equal in _meetings(batch, floor):
                if i != row:
                    row, known, (bands, other_bands) = i, {}, (_rows_of(z["bands"]) for z in (x, y))
                    band = batch.column(2)[i].as_py()
                own = x["members"][at].values.to_numpy().view(np.uint64)  # sorted as such
                first = ~(bands[at, :band][None, :] == other_bands[good][:, :band]).any(axis=1)
                linked = set()
                for b in good[first][np.argsort(-equal[first], kind="stable")].tolist():
                    if (part := y["component"][b].as_py()) in linked:
                        continue
                    if b not in known:
                        known[b] = y["members"][b].values.to_numpy().view(np.uint64)
                    other = known[b]
                    both = np.count_nonzero(other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        linked.add(part)
                        links.append((x["doc_id"][at].as_py(), y["doc_id"][b].as_py()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], names=["a", "b"])

    return run


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with the columns of docs; of rows of one id, one stays."""
    marked = near_duplicates(docs).where("kept").select(*docs.columns)
    return marked.where("doc_id is null").unionByName(marked.where("doc_id is not null").dropDuplicates(["doc_id"]))
