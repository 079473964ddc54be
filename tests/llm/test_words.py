"""Collocations, the audit of filters and the model of quality rules: plain Python on fixtures, and edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from lexspark.llm import collocations, filter_audit, quality_rules, queries
from lexspark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    None, "", "   \n\t ", "one", "two words", "É ß 漢字 🙂 Ω", "x" * 100_000, "\n\n\n", "a\0b a\0b", "a b " * 3000, "A. b! c? d;e:f,g\rh\x0bi\x0cj",
    "same same\nsame same\n \n \nsame same", "# $ % & * | < >",
]


def make(spark, texts, langs=("en",), clash=None):
    rows = [(i, t, langs[i % len(langs)], f"s{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn(clash, F.lit("mine")) if clash else df


# --- 11 collocations


def brute_collocations(rows, least=10, top=2000):
    """(lang, text) rows to the set of results, by counting every phrase of one to three words."""
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") != lang:
                continue
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
                w = re.findall("[^ \t]+", piece)
                n += len(w)
                for k in (1, 2, 3):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts_of(seed, n, words=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)] + ["Ça", "İx", "漢字"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return ["".join(rng.choices(vocab, weights)[0] + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "W5 "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "shard"), [(1, 8 << 20), (2, 400), (3, 1)])
def test_collocations_equal_plain_python(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    texts = texts_of(seed, 150) + EDGE
    langs = ("en", "de", None)
    docs = make(spark, texts, langs, "phrase").repartition(3)
    rows = [tuple(r) for r in collocations.collocations(docs).collect()]
    assert sorted(rows) == brute_collocations([(langs[i % 3], t) for i, t in enumerate(texts)])


def test_collocations_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(10**13, 2 * 10**13, 3 * 10**13)], "a long, l long, r long").select(collocations._cut("l", "r", 1).alias("c"))
    assert rows.first()["c"]["score"] == 1_000_000 * 10**26 // (6 * 10**26)


def test_collocations_top_and_edges(spark):
    docs = make(spark, texts_of(5, 200))
    short = [tuple(r) for r in collocations.collocations(docs, top=3).collect()]
    assert sorted(short) == brute_collocations([("en", r["text"]) for r in docs.collect()], top=3)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(make(spark, [None, "", " . "])).count() == 0
    double = [tuple(r)[3] for r in collocations.collocations(docs.union(docs), least=20, top=5).orderBy("rank").collect()]
    assert double == [2 * tuple(r)[3] for r in collocations.collocations(docs, top=5).orderBy("rank").collect()]


def test_bitmaps_come_back():
    words, opens = np.array([0, 1, 0, 0, 2, 1, 1, 0, 0, 2] * 9, np.int32), np.array(([True] + [False] * 6) * 12 + [True] * 6)
    word, block, mask, inside = collocations.unpack(collocations.pack(words, opens, 3))
    places = sorted((8 * int(b) + i, int(w)) for w, b, m in zip(word, block, mask, strict=True) for i in range(8) if m >> i & 1)
    assert [w for _, w in places] == words.tolist()
    assert [not (inside[i >> 3] >> (i & 7)) & 1 for i in range(len(opens))] == opens.tolist()


# --- 12 audit


def brute_audit(docs, labels):
    """Apply the filters one after another, in each order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first: dict = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        own += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and first[t] < i)
        fails.append((source or "", own, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                hit = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                total[letter] += len(hit)
                gone = [r for r in rows if letter in r[1] and r not in hit]
                lone = sum(r[1] == letter for r in rows)
                redundant = sum(letter in r[1] for r in rows) - len(hit)
                out[part, order, step] = [len(left), len(hit), redundant, lone, sum(r[2] for r in hit), sum(r[3] for r in hit)]
                assert redundant >= 0 and gone is not None
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(total[letter])
    return out


def test_audit_equals_plain_python(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(["alpha", "Bravo", "CH#RLIE", "delta", "é", "x|y"] + [f"n{i}" for i in range(80)], k=rng.randint(0, 120))) for _ in range(25)]
    texts = EDGE + base + base[:10] + [base[0]] * 4
    docs = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    docs += [(3, "again", "s1"), (3, base[2], "s1"), (5, texts[5], "s0"), (None, base[1], "s2"), (None, None, None), (None, base[1], "s2"), (-1, base[4], "s0")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(40)] + [(5, None, None), (None, 1, 1), (4, 0, 1), (4, 1, None)]
    rows = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("mine")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(rows) == len(got) == 600 * 4
    assert got == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    docs, labels = make(spark, ["a"]), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


# --- 13 rules


def brute_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_measures_equal_plain_python(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices(["a", "B", "b", "É", "#c", "d.", "e\n", "\n", "f\r", "漢|", "g!"], k=rng.randint(0, 90))) for _ in range(120)]
    texts = EDGE + base + ["a b c d e a b c d e", "a a a a a a", "a a a a a", "x\nx\r\nx\r\n", "x \nx\n x"]
    found = quality_rules.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(found[name][i]) for name in quality_rules.MEASURES) == brute_measures(t), (i, t and t[:60])
    rows = quality_rules.judge(make(spark, texts, clash="kept")).collect()
    for r in rows:
        n, *_, again = brute_measures(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_em_equals_plain_python():
    """The fitted tables are a fixed point of one step of expectation and maximisation in plain Python."""
    rng = np.random.default_rng(2)
    bad = rng.random(4000) < 0.2
    votes = np.array([[rng.choice(3, p=(0.5, 0.4, 0.1) if b else (0.05, 0.35, 0.6)) for _ in range(6)] for b in bad])
    table, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(table, counts.astype(float))
    total, weight = counts.sum(), quality_rules.PRIOR_WEIGHT * counts.sum()
    prior = {0: (quality_rules.BAD_SHARE, quality_rules.PRIOR_VOTES["bad"]), 1: (1 - quality_rules.BAD_SHARE, quality_rules.PRIOR_VOTES["good"])}
    seen = [[[prior[c][0] * weight * p for p in prior[c][1]] for c in (0, 1)] for _ in range(6)]
    mass = [prior[0][0] * weight, prior[1][0] * weight]
    for row, n in zip(table, counts, strict=True):
        like = [s * math.prod(model.tables[r, c, v] for r, v in enumerate(row)) for c, s in ((0, model.share), (1, 1 - model.share))]
        assert quality_rules.posterior(model, row[None])[0] == pytest.approx(like[1] / sum(like))
        for c in (0, 1):
            mass[c] += n * like[c] / sum(like)
            for r, v in enumerate(row):
                seen[r][c][v] += n * like[c] / sum(like)
    for r in range(6):
        for c in (0, 1):
            assert model.tables[r, c] == pytest.approx([x / sum(seen[r][c]) for x in seen[r][c]], abs=1e-6)
    assert model.share == pytest.approx(mass[0] / (total + weight), abs=1e-6)
    assert abs(model.share - 0.2) < 0.03 and (model.accuracies() > 0.7).all()
    same = quality_rules.fit(table, counts * 1000.0)
    assert same.tables == pytest.approx(model.tables, abs=1e-6)  # alike at every size


def test_votes_abstain_and_exclude_each_other(spark):
    rows = quality_rules.judge(make(spark, [*EDGE, " ".join(["Le mot, la vie."] + [f"mot{i} du jour," for i in range(30)])])).collect()
    assert {v for r in rows for v in r["votes"]} == {0, 1, 2} and len(rows[0]["votes"]) == len(quality_rules.rules())


def test_rules_on_labelled_documents(spark):
    """No label is read, yet what the rules' model keeps agrees with the labels."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, carry=["doc_id"]).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_rules_edges(spark):
    docs = make(spark, EDGE)
    assert quality_rules.judge(docs.limit(0)).count() == 0
    twice = quality_rules.judge(docs.union(docs)).collect()
    assert len(twice) == 2 * len(EDGE) and len({(r["doc_id"], r["posterior"]) for r in twice}) == len(EDGE)
    kept = quality_rules.drop_bad(make(spark, [" ".join(f"word{i} of the day," for i in range(40)), None]))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [0]


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_filter_audit"])
def test_new_queries_equal_their_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), queries.ORACLES[name]) == ""
