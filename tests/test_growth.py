"""What queries hold or make grows with their input: rows, tokenisations, partitions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexspark import catalog
from lexspark.operators import decks, gloss_segments, identity, vocabulary


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phrase_places_are_scanned_once(spark, sf):
    key = spark.createDataFrame([("of the of the of",), ("soft the of",), ("",), (None,)], "k string")
    got = [tuple(r) for r in key.select(vocabulary.places(F.col("k"), "of the"), vocabulary.places(F.col("k"), "the of"), vocabulary.places(F.col("k"), "of")).collect()]
    assert got == [(2, 2, 3), (0, 1, 1), (0, 0, 0), (None, None, None)]
    assert "lambda" not in plan(catalog.queries()["phrase_spans"](spark, sf))  # no tokens inside a step of a list


def test_card_gloss_is_written_once(spark):
    df = spark.createDataFrame([("a, b; c",)], "t string").select(gloss_segments.card_gloss(F.col("t")))
    assert plan(df).count("regexp_extract_all") <= 6


def test_nearest_pairs_decide_as_all_pairs_do(spark):
    rng = random.Random(5)
    left = [(s, i, rng.choice([None, *[x / 4 for x in range(-400, 400)]])) for i in range(150) for s in (1, 2, None)]
    right = [(s, i, rng.choice([None, *[x / 4 for x in range(-400, 400)]])) for i in range(60) for s in (1, 2, 3)]
    a, b = spark.createDataFrame(left, "scope int, l long, a double"), spark.createDataFrame(right, "scope int, r long, b double")
    key = lambda c: F.col(c) + 1000 * F.col("scope")
    a, b = a.withColumn("l", key("l")), b.withColumn("r", key("r"))
    near = (-F.round(F.abs(F.col("a") - F.col("b")), 0)).alias("near")
    some = identity.nearest_pairs(a, b)
    assert some.count() <= 4 * (300 + 180)
    got, want = (sorted(tuple(r) for r in identity.mutual_best(p.select("l", "r", near), "l", "r", "near").select("l", "r").collect()) for p in (some, a.join(b, "scope")))
    assert got == want and got


def test_first_of_kinds_hold_the_first_of_others(spark):
    rows = [("n", i % 5, i) for i in range(15)]
    got = vocabulary.first_of_kinds(spark.createDataFrame(rows, "g string, kind int, i int"), "g", "i", 6)
    assert sorted(r["i"] for r in got.collect()) == [0, 1, 2, 3, 4, 5]


def test_words_are_counted_in_parts_that_follow_the_input(spark, sf, monkeypatch):
    from lexspark import session
    from lexspark.operators import lines

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, lines.word_counts(docs).collect()))
    monkeypatch.setattr(session, "PART", 4_000)
    counts = lines.distinct_lines(docs)
    assert counts.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, lines.word_counts(docs).collect())) == whole


def test_retirement_makes_no_row_for_a_pair_and_keeps_the_order(spark, monkeypatch):
    import numpy as np

    from lexspark.operators import retirement

    x = np.random.default_rng(3).normal(size=(300, 6))
    rows = spark.createDataFrame([("a", i, [float(c) for c in v]) for i, v in enumerate(x)], "g string, i long, v array<double>")
    kept, want = [], {}
    for i, v in enumerate(x):
        near = [k for k in kept if x[k] @ v / np.linalg.norm(x[k]) / np.linalg.norm(v) >= 0.7]
        want[i] = near[0] if near else i
        kept += [] if near else [i]
    monkeypatch.setattr(retirement, "BLOCK", 40)
    monkeypatch.setattr(retirement, "ROWS", 50)
    df = retirement.retire(rows, "g", "i", "v", "i", 0.7)
    assert {r["i"]: r["kept_by"] for r in df.collect()} == want and len(kept) > 40


def _parts_follow(spark, sf, monkeypatch, name):
    """The query's own exchange has more partitions than the session's if its input holds more."""
    from lexspark import session

    monkeypatch.setattr(session, "PART", 2_000)
    text = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return "REPARTITION_BY_NUM" in text


def test_split_is_dealt_by_input(spark, sf, monkeypatch):
    assert _parts_follow(spark, sf, monkeypatch, "split_largest_remainder")


def test_leaf_is_dealt_by_input(spark, sf, monkeypatch):
    assert _parts_follow(spark, sf, monkeypatch, "displayed_leaf")


def test_ngrams_are_made_and_counted_in_parts_that_follow_the_input(spark, sf, monkeypatch):
    from lexspark import session
    from lexspark.operators import lines

    docs = spark.createDataFrame([(1, "a b a b, a b\nA b!", "s"), (2, "a b a b", "s"), (2, "b a b\nc", "s"), (3, None, "s")], "doc_id long, text string, source string")
    got = {r["ngram"]: (r["n"], r["count"], r["doc_count"], r["line_count"]) for r in lines.ngram_counts(docs).collect()}
    # ab abab | abab bab: a document's rows are one document, a stretch counts once
    assert got == {"a b": (2, 6, 2, 4), "b a": (2, 3, 2, 3), "a b a": (3, 2, 2, 2), "b a b": (3, 3, 2, 3), "a b a b": (4, 2, 2, 2)}
    monkeypatch.setattr(session, "PART", 4_000)
    for counted in (lines.ngram_counts(spark.read.parquet(f"{sf}/documents.parquet"), (2, 3), marked) for marked in (True, False)):
        text = counted._jdf.queryExecution().executedPlan().toString()
        assert "slice" not in text and text.count("REPARTITION_BY_NUM") == 2
        assert counted.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_slot_families_leave_other_phrases_before_they_count(spark, sf, monkeypatch):
    assert _parts_follow(spark, sf, monkeypatch, "slot_families")
    text = plan(catalog.queries()["slot_families"](spark, sf))
    assert "line_count" not in text and text.count("Aggregate [n") == 2


def test_backup_candidates_are_stored_without_pairs_and_once(spark, sf, monkeypatch):
    from lexspark.operators import backups

    rows = spark.createDataFrame([("a b c d e f", "a b c d e f".split())], "key string, tokens array<string>")
    found = backups.sentences(rows, spark.createDataFrame([(w, i + 1) for i, w in enumerate("abcdef")], "word string, rank int"))
    assert found.columns == ["word", "rank", "key", "total", "burden", "beyond"]
    written, write = [], backups.cut
    monkeypatch.setattr(backups, "cut", lambda df, name, *more: written.append(name) or write(df, name, *more))
    assert backups.choose(found, 3).count() == 4
    assert written.count("candidates") == 1 and "pool" not in written


def test_cover_examples_go_to_their_words_once(spark):
    from lexspark.operators import examples

    index = spark.createDataFrame([("a b c", 3, 2, [1, 2, 3])], "key string, n long, easiness long, ranks array<int>")
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, rank int")
    chosen = examples.cover_examples(index, ranks, 3)
    assert sorted(map(tuple, chosen.collect())) == [(w, "a b c", 1, 2) for w in "abc"]
    assert plan(chosen).count("Join") == 1 and plan(chosen).count("xxhash64") <= 2


def test_documents_of_one_class_are_compared_once(spark, monkeypatch):
    rng = random.Random(8)
    common = [f"common line {c}" for c in "abcdefgh"]
    texts = {}
    for i in range(60):
        start = rng.randrange(4)
        mine = [f"own line {i} {k}" for k in range(rng.randint(0, 4))]
        texts[i] = mine + rng.choice([common[start : start + rng.randint(1, 5)], ["Common LINE a"], rng.sample(common, 3)])
    texts[60], texts[61] = texts[0], ["common line a", "x", *texts[1]]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()] + [(62, None)], "doc_id long, text string")
    firsts = {}
    for i, t in texts.items():
        if t not in [texts[j] for j in range(i) if j in texts]:
            firsts[i] = {}
            for k, line in enumerate(t):
                if len(line.split()) >= 3:
                    firsts[i].setdefault(line.lower(), k)
    want = {}
    for a in firsts:
        for b in firsts:
            places = {(firsts[a][x], firsts[b][x]) for x in firsts[a].keys() & firsts[b].keys()} if a < b else set()
            run = max((next(k for k in range(1, 99) if (p + k, q + k) not in places) for p, q in places), default=0)
            pct = round(len(places) / max(1, min(len(firsts[a]), len(firsts[b]))), 4)
            if places and (run >= 4 or pct >= 0.3):
                want[a, b] = (len(places), run, pct)
    monkeypatch.setattr(decks, "CHUNK", 2)
    rows = decks.shared_lines(docs).collect()
    assert {(r["a"], r["b"]): (r["shared"], r["run"], r["pct"]) for r in rows} == want and len(rows) == len(want) > 300
    same = spark.createDataFrame([(i, f"own line {i}\nsome common line") for i in range(40)], "doc_id long, text string")
    compared, found = [], decks._of_members
    monkeypatch.setattr(decks, "_of_members", lambda pairs, *more: compared.append(pairs.count()) or found(pairs, *more))
    assert decks.shared_lines(same).count() == 40 * 39 // 2 and compared == [1]


def test_inner_substrings_are_made_in_parts_that_follow_the_phrases(spark, monkeypatch):
    from lexspark.operators import lines

    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=3)) for _ in range(30)]
    rows = sorted({(n, " ".join(rng.choices(words, k=n))) for n in (2, 3, 4, 5) for _ in range(150)})
    kept = [p for n, p in rows if n == 5]
    for n in (4, 3, 2):
        kept += [p for k, p in rows if k == n and not any(p in x for x in kept)]
    dealt, inner = [], lines.inner_strings
    monkeypatch.setattr(lines, "inner_strings", lambda df: dealt.append(df.rdd.getNumPartitions()) or inner(df))
    from lexspark import session

    monkeypatch.setattr(session, "PART", 10_000)
    got = lines.overlap_dedupe(spark.createDataFrame(rows, "n int, ngram string")).collect()
    assert sorted(r["ngram"] for r in got) == sorted(kept) and len(kept) < len(rows)
    assert min(dealt) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_top_lines_are_dealt_by_input(spark, sf, monkeypatch):
    assert _parts_follow(spark, sf, monkeypatch, "top3_lines_per_word_doc")


def test_inner_substrings_are_never_broadcast(spark, monkeypatch):
    from lexspark.operators import lines

    plans, write = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df, name, *more: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name, *more))
    rows = spark.createDataFrame([(5, "a b c d e"), (4, "b c d e"), (3, "x y z"), (2, "x y"), (2, "c d")], "n int, ngram string")
    assert sorted(r["ngram"] for r in lines.overlap_dedupe(rows).collect()) == ["a b c d e", "x y z"]
    kept = [p for name, p in plans if name == "kept"]
    assert len(kept) == 3 and all("LeftAnti" in p and "Broadcast" not in p for p in kept)


def test_ngrams_of_all_sizes_go_once_for_each_place(spark):
    from lexspark.operators import lines

    docs = spark.createDataFrame([(1, "a b c d e f, a b c"), (2, "a b c\na b")], "doc_id long, text string")
    placed = lines._windows(docs, (2, 3, 4, 5), True)
    assert placed.count() == 6 + 3 + 3 + 2  # one row for each word, not one for each word and size
    got = {r["ngram"]: (r["count"], r["doc_count"], r["line_count"]) for r in lines.ngram_counts(docs, (1, 2, 3)).collect()}
    assert got["a"] == (4, 2, 4) and got["a b"] == (4, 2, 4) and got["a b c"] == (3, 2, 3) and got["f"] == (1, 1, 1)
