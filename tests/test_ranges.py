"""Numbers and sums by range, study bands and backup sentences, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexspark.operators import backups, bands, numbering, selection


def test_ranks_of_one_value_have_no_hot_task(spark):
    rows = spark.range(40_000).select(F.lit(7).alias("n"), F.sha1(F.col("id").cast("string")).alias("word"))
    placed = numbering._ranged(rows, [F.desc("n"), F.asc("word")], 200)
    sizes = sorted(r["count"] for r in placed.groupBy("__part").count().collect())
    assert len(sizes) > 190 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    got = {r["word"]: r["rank"] for r in numbering.ranked(rows, "n", "word", parts=200).collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(got))}


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_and_sums_equal_plain_python(spark, parts):
    rng = random.Random(parts)
    data = [(i, rng.choice([1, 1, 1, 2, 5, 9])) for i in range(500)]
    rows = spark.createDataFrame(data, "id int, n int")
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    assert {r["id"]: r["rank"] for r in numbering.ranked(rows, "n", "id", parts=parts).collect()} == {i: k + 1 for k, (i, _) in enumerate(order)}
    shared = {r["id"]: r["rank"] for r in numbering.ranked(rows, "n", None, parts=parts).collect()}
    assert shared == {i: 1 + sum(m > n for _, m in data) for i, n in data}
    sums = {r["id"]: r["s"] for r in numbering.running_sums(rows, [F.asc("id")], {"s": "n"}, parts).collect()}
    assert sums == {i: sum(n for j, n in data if j < i) for i, _ in data}
    assert numbering.ranked(rows.limit(0), "n", "id").count() == 0


def test_ranks_take_no_window_over_all_rows(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("n"), "id")
    plan = selection.ranked(rows, "n", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Project")[0] and "row_number" not in plan


def _bands(uses):
    """Plain Python of the rules: equal slices, cut at the nearest drop."""
    items = sorted(uses, reverse=True)
    total = len(items)
    n = min(total, 80, max(10, math.ceil(total / 200)))
    ideal = total / n
    snap, least = max(2, math.floor(ideal * 0.25 + 0.5)), max(1, math.floor(ideal * 0.5 + 0.5))
    drops = [c for c in range(1, total) if items[c - 1] != items[c]]
    ends, before = [], 0
    for k in range(1, n):
        low, high = before + least, total - (n - k) * least
        aim = max(low, min(high, math.floor(total * k / n + 0.5)))
        near = [d for d in drops if low <= d <= high and abs(d - aim) <= snap]
        before = min(near, key=lambda d: (abs(d - aim), d)) if near else aim
        ends.append(before)
    ends.append(total)
    return [
        (k + 1, a + 1, b - a, items[b - 1], b < total and items[b] == items[b - 1], round(100 * sum(items[:b]) / sum(items), 3))
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))
    ]


@pytest.mark.parametrize("size", [1, 7, 10, 33, 79, 80, 95, 450, 3000])
def test_study_bands_equal_plain_python(spark, size):
    rng = random.Random(size)
    for spread in (1.2, 3.0):
        uses = [int(rng.paretovariate(spread)) + 1 for _ in range(size)]
        got = bands.study_bands(spark.createDataFrame([(u,) for u in uses], "uses int"), "uses").orderBy("band").collect()
        assert [tuple(r) for r in got] == _bands(uses)


def test_study_bands_of_nothing(spark):
    assert bands.study_bands(spark.createDataFrame([], "uses int"), "uses").count() == 0


def _backups(keys, ranks, per_word, reuse):
    """One word after another, as the rules are told."""
    own = {k: k.split(" ") for k in sorted(set(keys)) if 5 <= len(k.split(" ")) <= 16}
    used, out = Counter(), {}
    for word in sorted(ranks, key=lambda w: (ranks[w], w)):
        scored = []
        for key, toks in own.items():
            if word in toks:
                logs = [math.log10(ranks.get(t, 60_000)) for t in set(toks)]
                costs = sorted((x - math.log10(ranks[word]) for x in logs if x > math.log10(ranks[word])), reverse=True)
                burden = round(0.35 * costs[0] + sum(costs[1:]), 9) if costs else 0.0
                total = round(burden + 0.6 * max(0, 6 - len(toks)) + 0.3 * max(0, len(toks) - 12), 9)
                scored.append((total, burden, len(costs), key))
        picks = []
        for any_ in (False, True):
            for *_, key in sorted(scored):
                pairs = set(zip(own[key], own[key][1:], strict=False))
                alike = any(len(pairs & set(zip(own[p], own[p][1:], strict=False))) >= 2 for p in picks)
                if len(picks) < per_word and key not in picks and used[key] < reuse and (any_ or not alike):
                    picks.append(key)
                    used[key] += 1
        for place, key in enumerate(picks, 1):
            out[word, place] = key
    return out


@pytest.mark.parametrize("reuse", [1, 2, 4])
def test_backup_sentences_equal_one_after_another(spark, reuse):
    rng = random.Random(reuse)
    words = [f"w{i}" for i in range(40)]
    keys = [" ".join(rng.choices(words, weights=range(41, 1, -1), k=rng.randint(4, 17))) for _ in range(90)]
    keys += keys[:10]
    ranks = {w: i + 1 for i, w in enumerate(words) if i % 9 != 8}
    rows = spark.createDataFrame([(k,) for k in keys], "key string").withColumn("tokens", F.split("key", " "))
    candidates = backups.sentences(rows, spark.createDataFrame(list(ranks.items()), "word string, rank int"))
    got = {(r["word"], r["place"]): r["key"] for r in backups.choose(candidates, per_word=3, reuse=reuse).collect()}
    assert got == _backups(keys, ranks, 3, reuse)


def test_backup_sentences_of_nothing(spark):
    rows = spark.createDataFrame([], "key string, tokens array<string>")
    ranks = spark.createDataFrame([("a", 1)], "word string, rank int")
    assert backups.choose(backups.sentences(rows, ranks)).count() == 0


def _cover(sentences, ranks, k, pool):
    """Plain greedy over the sorted pool of each word."""
    index = {}
    for key in set(sentences):
        toks = key.split(" ")
        all_ = sorted(ranks.get(t, 999_999) for t in toks)
        own = {ranks[t] for t in toks if t in ranks}
        if 3 <= len(toks) <= 18 and all_[-1] > 100 and own:
            mid = len(all_) // 2
            index[key] = (int(all_[mid] if len(all_) % 2 else (all_[mid - 1] + all_[mid]) / 2), len(toks), own)
    out = set()
    for word, rank in ranks.items():
        rated = []
        for key, (easy, n, own) in index.items():
            if rank in own:
                near = {r for r in own if r != rank and abs(r - rank) <= 50}
                rated.append((-min(10, len(near)), easy + 5 * max(0, n - 12), key, near))
        best = [r for r in sorted(rated, key=lambda r: r[:3]) if r[0]][:pool]
        picks, covered = [], set()
        while best and len(picks) < k:
            gains = [len(r[3] - covered) for r in best]
            if not max(gains):
                break
            picks.append(best.pop(gains.index(max(gains))))
            covered |= picks[-1][3]
        if not picks:
            picks = sorted(rated, key=lambda r: r[1:3])[:k]
        out |= {(word, r[2], i, -r[0]) for i, r in enumerate(picks, 1)}
    return out


@pytest.mark.parametrize(("k", "pool"), [(3, 200), (5, 4)])
def test_cover_examples_equal_plain_greedy(spark, k, pool):
    from lexspark.operators import examples

    rng = random.Random(k)
    words = [f"w{i}" for i in range(260)]
    ranks = {w: i + 1 for i, w in enumerate(words) if i % 11 != 10}
    keys = [" ".join(rng.choices(words, weights=[1 / (i + 5) for i in range(260)], k=rng.randint(2, 19))) for _ in range(120)] + ["w0 w1 w2", "w250 w9 w0"]
    rows = spark.createDataFrame([(x,) for x in keys], "key string").withColumn("tokens", F.split("key", " "))
    table = spark.createDataFrame(list(ranks.items()), "word string, rank int")
    got = examples.cover_examples(examples.sentence_index(rows, table), table, k, pool)
    want = _cover(keys, ranks, k, pool)
    assert {tuple(r) for r in got.select("word", "key", "place", "tier").collect()} == want and got.count() == len(want)
    assert any(t == 0 for *_, t in want)


def test_cover_examples_look_at_all_sentences(spark):
    from lexspark.operators import examples

    # 300 sentences cover more ranks than the one that alone adds a new one
    ranks = {f"w{i}": i for i in range(1, 402)}
    near = [" ".join(f"w{i}" for i in (150, 151, 152, 153)) + f" x{'abcdefghij'[n // 100]}{'abcdefghij'[n // 10 % 10]}{'abcdefghij'[n % 10]}" for n in range(300)]
    keys = [*near, "w150 w160 w161 z", "w400 x y", "w400 y x", "w400 y y y"]
    rows = spark.createDataFrame([(x,) for x in keys], "key string").withColumn("tokens", F.split("key", " "))
    table = spark.createDataFrame(list(ranks.items()), "word string, rank int")
    got = examples.cover_examples(examples.sentence_index(rows, table), table, 3)
    got = [tuple(r) for r in got.select("word", "key", "place", "tier").collect()]
    assert set(got) == _cover(keys, ranks, 3, None) and len(set(got)) == len(got)
    assert ("w150", "w150 w160 w161 z", 2, 2) in got and ("w400", "w400 y y y", 3, 0) in got


@pytest.mark.parametrize("reuse", [1, 3])
def test_backup_sentences_go_on_behind_their_head(spark, reuse):
    rng = random.Random(reuse + 10)
    words = [f"w{i}" for i in range(14)]
    # most sentences are alike
    keys = [" ".join(["w0 w1 w2 w3", *rng.choices(words, k=rng.randint(1, 4))]) for _ in range(40)] + [" ".join(rng.choices(words, k=7)) for _ in range(25)]
    ranks = {w: i + 1 for i, w in enumerate(words) if i != 5}
    rows = spark.createDataFrame([(k,) for k in keys], "key string").withColumn("tokens", F.split("key", " "))
    candidates = backups.sentences(rows, spark.createDataFrame(list(ranks.items()), "word string, rank int"))
    got = {(r["word"], r["place"]): r["key"] for r in backups.choose(candidates, per_word=3, reuse=reuse, head=4).collect()}
    assert got == _backups(keys, ranks, 3, reuse)


def test_backup_sentences_are_chosen_of_all_candidates(spark):
    of = lambda n: "".join("abcdefghij"[int(d)] for d in f"{n:04d}")
    key = F.udf(lambda n: f"w {of(n)} p{of(n)} q{of(n)} r{of(n)}")
    # word by word the same cost: the first by key
    rows = spark.range(9000).select(key("id").alias("key")).withColumn("tokens", F.split("key", " "))
    candidates = backups.sentences(rows, spark.createDataFrame([("w", 1)], "word string, rank int"))
    got = [r["key"] for r in backups.choose(candidates, per_word=10).orderBy("place").collect()]
    assert got == [f"w {of(n)} p{of(n)} q{of(n)} r{of(n)}" for n in range(10)]
