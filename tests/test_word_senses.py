"""Headword rules, pronoun gates, verb tables and groups of glosses on small fixtures."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexspark.operators import cognates as C
from lexspark.operators import gloss_groups as G
from lexspark.operators import headwords as H

PAIRS = [
    ("cancion", "cancion", "", [], "self"), ("revol", "revolt", "", [], None), ("vuelvo", "volverse", "", ["volver"], "pointer"), ("venimo'", "venir", "", None, "table"),
    ("gritale", "grita", "", None, "enclitic"), ("finas", "fino", "", None, "variant"), ("manin", "mani", "", None, None), ("x", "", "", None, "empty"),
    ("admitelo", "admitir", None, None, "table"), ("lambos", "lamb", "", None, None), ("soy", "ser", " Conjugation ", None, "flag"), ("x", None, None, None, "empty"),
    ("luces", "luz", None, None, "variant"), (None, "luz", None, None, None), ("finas", "fino", "", None, "variant"),
]


def _lexicon(spark):
    reverse = spark.createDataFrame([("venimos", "venir"), ("admite", "admitir"), ("admito", "admitir"), ("grita", "gritar")], "form string, lemma string")
    return reverse, spark.createDataFrame([("fino",), ("mani",), ("grita",), ("luz",), (None,)], "form string")


def test_each_headword_rule(spark):
    pairs = spark.createDataFrame(PAIRS, "surface string, headword string, relation string, pointers array<string>, want string")
    reverse, forms = _lexicon(spark)
    got = H.vet_headwords(pairs, reverse, forms).collect()
    assert len(got) == len(PAIRS) and all(r["reason"] == r["want"] for r in got)
    unvetted = H.vet_headwords(pairs, reverse, forms.limit(0))
    assert {r["reason"] for r in unvetted.collect()} == {"unvetted"}
    assert H.vet_headwords(pairs.limit(0), reverse, forms).count() == 0


def test_only_surfaces_in_the_cache_are_purged(spark):
    menu = spark.createDataFrame([(p[0], p[1], p[2], i) for i, p in enumerate(PAIRS)], "surface string, headword string, relation string, n int")
    cache = spark.createDataFrame([("revol", None), ("vuelvo", ["volver"])], "surface string, pointers array<string>")
    kept, quarantine = H.purge_menu(menu, cache, *_lexicon(spark))
    assert [r["n"] for r in quarantine.collect()] == [1] and kept.count() == len(PAIRS) - 1 and kept.columns == menu.columns


def test_reflexive_modes(spark):
    rows = [
        ("dio", "ya me lo dio", ["3"], None, True, False), ("va", "se va", ["3"], True, True, True), ("veo", "me veo", ["1"], None, True, True),
        ("agradan", "me agradan", ["3"], None, True, False), ("x", "yo", [], None, None, None), ("come", "él come", ["3"], False, False, False),
        ("come", "te come", None, None, True, None), ("va", "va se va", ["3"], False, False, False),
    ]
    df = spark.createDataFrame(rows, "t string, line string, persons array<string>, a boolean, b boolean, c boolean").withColumn("toks", F.split("line", " "))
    for mode, want in (("se-only", "a"), ("permissive", "b"), ("dative-aware", "c")):
        got = df.select(H.reflexive(F.col("t"), F.col("toks"), mode, F.col("persons")).alias("got"), want).collect()
        assert [r["got"] for r in got] == [r[want] for r in got]


def test_first_form_of_a_slot(spark):
    rows = [
        (2, "vos hablás", "hablar", "indicativo", "presente", "2s"), (1, "hablas", "hablar", "indicativo", "presente", "2s"), (3, "hablando", "hablar", "gerundio", "", "2s"),
        (4, "yendo", "ir", "gerundio", "", ""), (5, "fuera", "ser", "subjuntivo", "pretérito-imperfecto", "1s"), (6, "sed", "ser", "imperativo", "presente", "2p"),
    ]
    morphology = spark.createDataFrame(rows, "ord int, form string, lemma string, mood string, tense string, person string")
    missing = spark.createDataFrame([("hablar",), ("ir",), ("ser",), ("ser",)], "lemma string")
    got = {tuple(r) for r in H.fallback_tables(morphology, missing).select("lemma", "slot", "person", "form").collect()}
    assert got == {("hablar", "Presente", "2s", "hablas"), ("hablar", "gerund", "", "hablando"), ("ser", "Subj. Imperfecto", "1s", "fuera")}


def test_proposals_join_in_order(spark):
    rows = [(1, "V", 1, "fake or inauthentic"), (1, "V", 2, "fake or counterfeit"), (1, "V", 3, "weed"), (1, "V", 4, "slang for marijuana or weed"), (1, "V", 5, "marijuana"), (2, "N", 6, None), (2, "N", 7, "")]
    df = spark.createDataFrame(rows, "w long, pos string, i long, g string")
    got = {(r["w"], r["cluster"], r["i"]) for r in G.cluster_proposals(df, ["w", "pos"], "g", ["i"], "i").collect()}
    assert got == {(1, 1, 3), (1, 1, 4), (1, 1, 5), (1, 2, 1), (1, 2, 2), (2, 1, 6), (2, 2, 7)}


def test_merged_senses_keep_the_longest(spark):
    rows = [(1, "N", 1, "car"), (1, "N", 2, "car, auto"), (1, "N", 3, "auto, Automobile (old)"), (1, "N", 4, "weed"), (2, "P", 1, "to"), (2, "P", 2, "To "), (2, "P", 3, "with")]
    df = spark.createDataFrame(rows, "w long, pos string, i long, g string")
    got = sorted((r["w"], r["i"], r["g"], r["senses"]) for r in G.merge_senses(df, ["w", "pos"], "g", "i").collect())
    assert got == [(1, 3, "auto, Automobile (old), car", 3), (1, 4, "weed", 1), (2, 2, "To ", 2), (2, 3, "with", 1)]


def test_clusters_equal_plain_python(spark):
    pick = random.Random(7)
    words = "alpha beta gamma delta rho sigma kappa".split()
    rows = [(k, "N", i, " ".join(pick.sample(words, pick.randint(1, 4)))) for k in range(40) for i in range(pick.randint(1, 9))]
    want = set()
    for k in range(40):
        clusters: list = []
        for _, g, _, i in sorted((len(g), g, i, i) for kk, _, i, g in rows if kk == k):
            toks = set(g.split())
            met = [c for c in clusters if len(c[0] & toks) / len(c[0] | toks) >= 0.25]
            if met:
                for other in met[1:]:
                    met[0][0].update(other[0])
                    met[0][1].extend(other[1])
                    clusters.remove(other)
                met[0][0].update(toks)
                met[0][1].append(i)
            else:
                clusters.append((toks, [i]))
        want |= {(k, n, i) for n, c in enumerate(clusters, 1) for i in c[1]}
    df = spark.createDataFrame(rows, "w long, pos string, i long, g string")
    assert {(r["w"], r["cluster"], r["i"]) for r in G.cluster_proposals(df, ["w", "pos"], "g", ["i"], "i").collect()} == want


def test_tags_and_names(spark):
    df = spark.createDataFrame([("slang", None, "NOUN", "name"), ("", "x", "propn", None), (None, None, None, "the name of a town"), ("proper_noun", None, None, None)], "type string, construction string, pos string, gloss string")
    got = df.select(H.is_name_sense(F.col("type"), F.col("pos"), F.col("gloss")).alias("n"), H.carry_tags(F.struct(F.lit("o").alias("type"), F.lit("c").alias("construction")), F.struct("type", "construction")).alias("m"))
    assert [(r["n"], r["m"]["type"], r["m"]["construction"]) for r in got.collect()] == [(False, "slang", "c"), (True, "o", "x"), (True, "o", "c"), (True, "proper_noun", "c")]


def _score(s: str, e: str) -> float:
    """The score in plain Python, for words without accents."""
    consonant = lambda c: c not in "aeiou"

    def one(w: str) -> str:
        return w[:-3] + "z" if len(w) > 3 and w.endswith("ces") else w[:-2] if len(w) > 4 and w.endswith("es") else w[:-1] if len(w) > 3 and w.endswith("s") else w

    def said(w: str) -> str:
        out = ""
        w = w.replace("ph", "f").replace("th", "t").replace("qu", "cu")
        for i, c in enumerate(w):
            alone = c == "y" and (not out or consonant(out[-1])) and (i + 1 == len(w) or consonant(w[i + 1]))
            out += "i" if alone else c
        return out

    if min(len(s), len(e)) < 4:
        return 0.0
    a, b = one(s), one(e)
    bare = a[1:] if len(a) > 3 and a[:2] == "es" and consonant(a[2]) else a
    if any(x == b or any(x.endswith(p) and len(x) > len(p) and x[: -len(p)] + q in (b, e) for p, q in C.COGNATES) for x in (a, bare)):
        return 1.0
    pairs = [(x, y) for x in (a, bare) for y in (b, said(b))] if min(len(a), len(b)) > 5 else [(a, b)]
    return round(max(SequenceMatcher(None, x, y).ratio() for x, y in pairs), 3)


def test_cognate_scores_equal_plain_python(spark):
    pick = random.Random(11)
    parts = "es qu ph th cion tion oso ous a e i y s t r ces mente ly fo to".split()
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(1, 5)))
    rows = [(word(), word()) for _ in range(400)] + [("especial", "special"), ("nacion", "nations"), ("famoso", "famous"), ("sistema", "system"), ("voces", "voz"), ("", "abcd")]
    rows += [(w, w[:-1] + "y") for w, _ in rows if w]
    got = C.cognate_scores(spark.createDataFrame(rows, "s string, e string"), "s", "e").collect()
    assert len(got) == len(rows)
    assert [(r["s"], r["e"], r["score"]) for r in got if abs(r["score"] - _score(r["s"], r["e"])) > 1e-9] == []
    nulls = C.cognate_scores(spark.createDataFrame([(None, "abcd"), ("abcd", None), ("Árbol", "arbol")], "s string, e string"), "s", "e").collect()
    assert [r["score"] for r in nulls] == [0.0, 0.0, 1.0]
