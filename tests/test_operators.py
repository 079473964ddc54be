"""Small fixtures that pin what an operator must do."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import decks, identity, learner, lines, morphology, scanning, retirement, selection, sense_rules, vocabulary


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


SONGS = [
    (1, "a", "Lyrics\nHola mundo uno dos tres\nHOLA, mundo uno dos tres\nAdiós mundo uno dos tres"), (2, "b", "Lyrics\nHola mundo uno dos tres"),
]


def test_lines_count_once_for_each_document(spark):
    docs = spark.createDataFrame(SONGS, "doc_id long, source string, text string")
    got = {r["word"]: (r["corpus_count"], r["doc_count"]) for r in lines.word_counts(docs).collect()}
    assert got["hola"] == (2, 2) and got["mundo"] == (3, 2) and got["adiós"] == (1, 1)
    grams = {r["ngram"]: r for r in lines.ngram_counts(docs, (2,)).collect()}
    assert grams["hola mundo"]["doc_count"] == 2 and grams["mundo uno"]["count"] == 4


def test_pmi_is_the_same_for_any_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (rows(lines.pmi_phrases(d), "n", "ngram", "pmi") for d in (docs.coalesce(1), docs.repartition(8)))
    assert a == b and a


def test_inner_strings_hold_every_containment(spark):
    phrase = spark.createDataFrame([(3, "ab cd ef")], "n int, ngram string")
    inner = {r["ngram"] for r in lines.inner_strings(phrase).collect()}
    assert {"ab cd", "b cd", "b c", "cd ef", "d e", "cd e"} <= inner and "ab" not in inner


def test_text_columns(spark):
    df = spark.createDataFrame([("(eh) no-no mover", "a((b)c)d", "Çédille", "banana")], "a string, b string, c string, d string")
    r = df.select(T.strip_adlibs(F.col("a")), T.nesting_depth(F.col("b")), T.fold_accents(F.col("c")), T.sort_letters(F.col("d"))).first()
    assert tuple(r) == ("mover", 2, "cedille", "aaabnn")


def test_stage_counts_right_answers_since_the_last_wrong_one(spark):
    at = lambda d: datetime(2024, 1, d)
    tries = spark.createDataFrame(
        [(1, 1, 7, at(1), True), (2, 1, 7, at(2), False), (3, 1, 7, at(3), True), (4, 1, 7, at(4), True), (5, 1, 8, at(1), None), (6, 1, 9, at(1), False), (7, 1, 10, at(1), True)],
        "event_id long, user_id long, item long, ts timestamp, correct boolean",
    )
    now = spark.createDataFrame([(at(6),)], "now timestamp")
    got = {r["item"]: (r["srs_stage"], r["state"], r["reason"], r["known"]) for r in learner.state(learner.progress(tries), now).collect()}
    assert got == {7: (2, "learned", None, True), 8: (0, "unseen", None, False), 9: (0, "review", "incorrect", False), 10: (1, "review", "due", True)}


def test_bands_have_floor_bounds(spark):
    items = spark.range(83).withColumnRenamed("id", "rank")
    got = {r["band"]: (r["a"], r["b"]) for r in learner.bands(items, "rank").groupBy("band").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).collect()}
    assert got == {0: (0, 40), 1: (41, 82)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 5)), min_size=1, max_size=6))
def test_isotonic_fit_does_not_rise_and_keeps_the_mean(spark, data):
    df = spark.createDataFrame([([float(v) for v, _ in data], [float(w) for _, w in data])], "v array<double>, w array<double>")
    fit = df.select(learner.isotonic(F.col("v"), F.col("w")).alias("f")).first()["f"]
    assert all(a >= b - 1e-9 for a, b in zip(fit, fit[1:], strict=False))
    assert sum(f * w for f, (_, w) in zip(fit, data, strict=True)) == pytest.approx(sum(v * w for v, w in data))


def test_claims(spark):
    claims = spark.createDataFrame(
        [(1, "pos", "x", "assert", 10, "r1", []), (2, "pos", "x", "assert", 50, "r1", []), (3, "pos", "x", "retract", 90, "r2", [2]), (4, "pos", "y", "abstain", 1, "r1", [])],
        "claim_id long, layer string, subject string, operation string, priority int, run_id string, supersedes array<long>",
    ).withColumn("confidence", F.lit(None).cast("double"))
    assert rows(identity.resolve_claims(claims), "subject", "claim_id") == [("x", 1), ("y", 4)]


def test_identity_columns(spark):
    df = spark.createDataFrame([(" Hola ", "Hi"), ("hola", "hi ")], "t string, e string")
    assert df.select(identity.example_id(F.col("t"), F.col("e")).alias("i")).distinct().count() == 1
    r = spark.createDataFrame([("a",)], "s string").select(identity.fnv1a(F.col("s"))).first()
    assert r[0] == 0xE40C292C


def test_identity_beyond_ascii_and_collisions(spark):
    def plain(text):  # FNV-1a over UTF-16 units
        h, data = 0x811C9DC5, text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "señal|verbo", "漢字", "🙂 x"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", identity.signature(F.col("s")).alias("h")).collect()
    assert {r["s"]: r["h"] for r in got} == {t: plain(t) for t in texts} and plain("a") == "e40c292c"

    import hashlib

    words = [f"sense{i}" for i in range(300)]  # among 4,096 prefixes some collide
    rows = spark.createDataFrame([("g", i, w) for i, w in enumerate(words)] + [("other", 0, words[0])], "g string, i int, w string")
    ids = {(r["g"], r["w"]): r["sense_id"] for r in identity.least_prefix_id(rows, ["g"], F.col("w"), ["i"]).collect()}
    want: dict[str, str] = {}
    for w in words:
        h = hashlib.md5(w.encode()).hexdigest()
        want[next(h[:n] for n in range(3, 33) if h[:n] not in want)] = w
    assert {ids["g", w]: w for w in words} == want and any(len(k) > 3 for k in want) and len(ids["other", words[0]]) == 3


def test_values_of_text_rules(spark):
    """Expected values worked out by hand from the rules."""
    one = lambda f, *texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(f(F.col("s"))).collect()]
    words = ("lying", "carries", "carried", "putting", "attraction", "sadness", "movement", "physically", "intensely", "placed", "harder", "places", "cats", "ties", "is", "s")
    assert one(morphology.stem_en, *words) == [
        "ly", "carry", "carry", "putt", "attracte", "sadnes", "move", "physical", "intense", "plac", "hard", "plac", "cat", "ti", "i", "s",
    ]
    assert one(T.normalize_text, "‘a’`b` –c—\r\nd\re\u2005f\u3000g\u200bh\ufeff despеrté", None) == ["’a’’b’ -c-\nd\ne f gh desperté", ""]
    assert one(T.lyric_tokens, "'Tamos aquí, 'toy pa'l ah-na-na post-guerra y 'e día; preguntó-tó") == [
        ["estamos", "aquí", "estoy", "pa'l", "post", "guerra", "y", "de", "día", "preguntó", "tó"]
    ]  # the last run has a chunk of over three letters
    labels = ("Plural Noun", "proper noun", "transitive verb", "reflexive pronoun", "adverbial phrase", "definite article", "phrase", "idiom", " Letter name ", None)
    assert one(morphology.normalize_pos, *labels) == ["NOUN", "PROPN", "VERB", "NOUN", "VERB", "DET", "PHRASE", "X", "NOUN", "X"]
    glosses = {
        "second person pronoun in singular tense; you": "you",
        "neuter definite article of many uses: the, that which is": "the, that which is",
        "to make (a decision) (used with people)": "to make (a decision)",
        "to take, to grab, to seize, to catch": "to take, to grab, to seize",
        "house; home, dwelling, abode; especially a small one; hut": "house; home, dwelling",
        "one; two; three; four": "one; two; three",
        "(archaic)": "(archaic)",
        "dog (an animal (tame), etc.)": "dog",
    }
    assert one(morphology.clean_gloss, *glosses) == list(glosses.values())


def test_changeset_and_store(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "q"), (4, "w")], "k int, v string")
    assert rows(identity.changeset(a, b, ["k"], ["v"]), "k", "change") == [(1, "insert"), (3, "update"), (4, "delete")]
    once = identity.append_only(a, b, "k")
    assert rows(once, "k", "v") == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert rows(identity.append_only(once, b, "k"), "k", "v") == rows(once, "k", "v")


def test_mutual_best_needs_one_best_each_way(spark):
    pairs = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, "b", 3), (3, "c", 2), (3, "d", 2)], "l int, r string, s int")
    assert rows(identity.mutual_best(pairs, "l", "r", "s"), "l", "r") == [(1, "a")]


def test_largest_remainder(spark):
    df = spark.createDataFrame([(1, 10, 1.0, 1), (1, 10, 1.0, 2), (1, 10, 1.0, 3), (2, 5, 0.0, 1), (2, 5, 0.0, 2)], "k int, total int, w double, o int")
    assert rows(selection.largest_remainder(df, ["k"], "total", "w", "o"), "k", "o", "part") == [(1, 1, 4), (1, 2, 3), (1, 3, 3), (2, 1, 3), (2, 2, 2)]


def test_greedy_cover_and_retire(spark):
    df = spark.createDataFrame([("k", 1, ["a", "b"], 1), ("k", 2, ["b", "c", "d"], 2), ("k", 3, ["a"], 3), ("k", 4, ["b"], 4)], "k string, i int, p array<string>, o int")
    assert rows(selection.greedy_cover(df, "k", "i", "p", "o", 3), "place", "i") == [(1, 2), (2, 1)]
    v = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.9, 0.1]), ("g", 3, [0.0, 1.0])], "g string, i int, v array<double>")
    assert rows(retirement.retire(v, "g", "i", "v", "i", 0.9), "i", "kept_by") == [(1, 1), (2, 1), (3, 3)]


def test_ranked_is_a_total_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "w string, n int")
    assert rows(selection.ranked(df, "n", "w"), "rank", "w") == [(1, "c"), (2, "a"), (3, "b")]
    assert rows(selection.ranked(df, "n", None), "rank", "w") == [(1, "c"), (2, "a"), (2, "b")]


def test_stable_id_misses_do_not_fall_back(spark):
    items = spark.createDataFrame([("x", 0), ("gone", 0), (None, 0)], "id string, idx int")
    ids = spark.createDataFrame([("x", "by id")], "id string, v string")
    places = spark.createDataFrame([(0, "by index")], "idx int, v string")
    got = decks.by_id_or_index(items, ids, places, "id", "idx", "v")
    assert {(r["id"], r["v"]) for r in got.collect()} == {("x", "by id"), ("gone", None), (None, "by index")}


def test_chase_ends_in_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "word string, base string")
    assert ("a", "d", 3) in rows(decks.chase(df), "word", "base", "hops")
    assert all(r[0] != r[1] for r in rows(decks.chase(df), "word", "base"))


def test_morphology(spark):
    words = spark.createDataFrame([(w,) for w in ("chico", "chiquito", "foto", "fotitos", "luz", "luces", "canción", "canciones", "dando", "dándolo", "besito", "papá")], "word string")
    assert rows(morphology.derivations(words, words), "word", "base") == [("chiquito", "chico"), ("fotitos", "foto")]
    assert rows(morphology.plural_redirects(words), "plural", "singular") == [("canciones", "canción"), ("luces", "luz")]
    assert ("dándolo", "dando", "lo") in rows(morphology.strip_clitics(words, words), "word", "host", "clitics")
    en = spark.createDataFrame([("nation",), ("famous",), ("city",)], "word string")
    es = spark.createDataFrame([("nación",), ("famoso",), ("casa",)], "word string")
    assert rows(morphology.cognates(es, en), "es", "en") == [("famoso", "famous"), ("nación", "nation")]
    r = spark.createDataFrame([("possessive pronoun", "to wants it")], "p string, g string")
    assert tuple(r.select(morphology.normalize_pos(F.col("p")), morphology.normalize_translation(F.col("g"))).first()) == ("NOUN", "want")


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="aé' ’.-b🙂", max_size=25))
def test_source_token_spans_match_a_scanner(spark, text):
    import regex

    df = spark.createDataFrame([(1, text)], "k int, line string")
    got = rows(scanning.source_tokens(df, "line"), "ordinal", "start", "end", "surface")
    assert got == [(i, m.start(), m.end(), m[0]) for i, m in enumerate(regex.finditer(scanning.SOURCE_TOKEN, text))]


def test_colliding_ids_slide(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(3000)], "w string")
    got = scanning.stable_ids(words, F.col("w"), 2)  # two digits, so that all collide
    assert got.where("length(id) <> 2").count() == got.where("length(id) < 2").count() < 3000
    assert scanning.stable_ids(words, F.col("w")).select("id").distinct().count() == 3000


def test_registry_refuses_unknown_and_odd_methods(spark):
    r = scanning.Registry()
    r.register("m", lambda d: d)
    with pytest.raises(ValueError):
        r.register("m", lambda d: d)
    with pytest.raises(KeyError):
        r.run("other", spark.range(1))
    with pytest.raises(ValueError):
        r.run("m", spark.range(1))


def test_capped_examples_empty_no_meaning(spark):
    df = spark.createDataFrame([(1, m, p) for m, n in (("a", 5), ("b", 1), ("c", 2)) for p in range(n)], "card int, m string, p int")
    got = rows(vocabulary.cap_examples(df, "card", "m", "p", 4), "m", "p")
    assert got == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    assert {m for m, _ in rows(vocabulary.cap_examples(df, "card", "m", "p", 1), "m", "p")} == {"a", "b", "c"}


def test_midpoints_breadth_first(spark):
    df = spark.createDataFrame([(n, i) for n in (1, 3, 10, 64) for i in range(n)], "n int, i int")
    got = df.select("n", "i", vocabulary.midpoint_level(F.col("i"), F.col("n")).alias("level")).orderBy("n", "level", "i").collect()
    for n in (1, 3, 10, 64):
        level, want = [(0, n - 1)], []
        while level:
            want += [(a + b) // 2 for a, b in level if a <= b]
            level = [x for a, b in level if a <= b for x in ((a, (a + b) // 2 - 1), ((a + b) // 2 + 1, b))]
        assert [r["i"] for r in got if r["n"] == n] == want


def test_vocal_artifacts(spark):
    toks = [(1, 0, i, t, x) for i, (t, x) in enumerate((("eh", True), ("ah", False), ("an", False), ("mover", False), ("over", False), ("casa", False)))]
    df = spark.createDataFrame(toks, "doc_id int, line_no int, i int, token string, inside boolean")
    lexicon = spark.createDataFrame([("mover",), ("casa",)], "word string")
    assert rows(vocabulary.vocal_artifacts(df, lexicon).where("label is not null"), "i", "label") == [(0, "adlib"), (1, "stutter"), (2, "stutter"), (4, "echo")]


def test_exact_surface(spark):
    df = spark.createDataFrame([("hola", "Dijo Hola."), ("a.b", "x A.B y"), ("ola", "hola")], "s string, line string")
    assert [r[0] for r in df.select(vocabulary.exact_surface("s", "line")).collect()] == ["Hola", "A.B", None]


def test_shared_lines_find_rare_overlaps(spark):
    common = ["la la common line", "another common line here"]
    docs = [(i, "\n".join([*common, *(f"line {j} of document {i}" for j in range(8))])) for i in range(12)]
    docs += [(20, "\n".join(common + [f"line {j} of document 3" for j in range(4)])), (21, "\n".join(common))]
    got = {(r["a"], r["b"]): (r["shared"], r["run"], r["pct"]) for r in decks.shared_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[(3, 20)] == (6, 6, 1.0) and got[(0, 21)] == (2, 2, 1.0)
    assert (0, 1) not in got  # two of ten lines


def test_transcriptions_and_sense_rules(spark):
    df = spark.createDataFrame([("'ap-p@l--b\"om",), ("a--b",), ("-'x-",), ("",)], "s string")
    out = df.select(sense_rules.strip_syllables(sense_rules.strip_stress(F.col("s"))), sense_rules.stress_pattern(F.col("s"))).collect()
    assert [tuple(r) for r in out] == [('app@l-b"om', "100"), ("a-b", "00"), ("x", "0"), ("", "")]
    # a syllable mark at the start of a syllable is its first character
    tags = spark.createDataFrame([("ADJ", "DET", ["DET"]), ("ADP", "NOUN", ["NOUN"]), ("PHRASE", "NOUN", ["NOUN"]), ("DET", "PRON", ["PRON", "NOUN"])], "s string, e string, o array<string>")
    got = tags.select(sense_rules.fits_observed(F.col("s"), F.col("o")), sense_rules.fits_example(F.col("s"), F.col("e")), sense_rules.fits_bridged(F.col("s"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(False, False, True), (False, False, False), (True, True, True), (True, True, True)]
    toks = spark.createDataFrame([(["una", "ve'", "vo'", "a", "ve'", "na'"],)], "t array<string>")
    assert toks.select(sense_rules.ngram_tokens(F.col("t"), {"na'": "nada"})).first()[0] == ["una", "vez", "voy", "a", "ves", "nada"]


def test_bands_without_a_share_stay_empty(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 1), (0.1, 0)], "p double, y int")
    assert rows(sense_rules.band_cuts(df, "p", "y", {"high": 1.0, "medium": 0.75, "never": 1.1}), "band", "cut") == [("high", 0.9), ("medium", 0.7), ("never", 0.9)]
