"""Attached pronouns, case by case."""

from __future__ import annotations

from lexspark.operators import enclitics

KNOWN = "dar ahogar alejar poner ver decir haciendo hacer ir par cuer fuer cortar llevar andar escandar creer crear comba combar parte mirar beber".split()
VERBS = "dar ahogar alejar poner ver decir hacer ir cortar llevar andar creer crear mirar beber".split()
IMPERATIVES = [("corta", "cortar", "2s"), ("lleva", "llevar", "2s"), ("anda", "andar", "2s"), ("escanda", "escandar", "2s"), ("cree", "crear", "3s"), ("cree", "creer", "2s"), ("comba", "combar", "2s"), ("da", "dar", "2s"), ("mira", "mirar", "2s")]
FORMS = [("escándalo", ["noun", "verb"], False), ("combate", ["noun", "verb"], False), ("ándale", ["intj", "verb"], False), ("dale", ["intj", "verb"], False), ("mirala", ["verb"], False), ("cortase", ["verb"], True)]
WANT = {
    "dándote": ("dar", ["te"], "gerund"), "ahogándome": ("ahogar", ["me"], "gerund"), "bebiéndolo": ("bebir", None, None), "diciéndomelo": (None, None, None),
    "alejarte": ("alejar", ["te"], "infinitive"), "dármelo": ("dar", ["me", "lo"], "infinitive"), "ponerse": ("poner", ["se"], "infinitive"), "verlo": ("ver", ["lo"], "infinitive"),
    "córtala": ("cortar", ["la"], "imperative"), "llévamelo": ("llevar", ["me", "lo"], "imperative"), "ándale": ("andar", ["le"], "imperative"), "créeme": ("creer", ["me"], "imperative"),
    "mirala": ("mirar", ["la"], "imperative"), "escándalo": (None, None, None), "combate": (None, None, None), "cortase": (None, None, None), "cuernos": (None, None, None),
    "fuerte": (None, None, None), "parte": (None, None, None), "luna": (None, None, None),
}


def _tables(spark):
    one = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    imperatives = spark.createDataFrame(IMPERATIVES, "word string, base string, person string")
    return one(WANT), one(KNOWN), one(VERBS), imperatives, spark.createDataFrame(FORMS, "word string, tags array<string>, conjugated boolean")


def test_decompose(spark):
    got = {r["word"]: (r["base"], r["clitics"], r["kind"]) for r in enclitics.decompose(*_tables(spark)).collect()}
    assert got == {w: v for w, v in WANT.items() if v[2]}
    words, *rest = _tables(spark)
    assert enclitics.decompose(words.limit(0), *rest).count() == 0


def test_tiers(spark):
    words = spark.createDataFrame([(w,) for w in (*WANT, "alejar", "dar", "irse", "corta")], "word string")
    listed = spark.createDataFrame([("irse", "ir", ["se"]), ("nunca", "x", ["te"])], "word string, base string, clitics array<string>")
    parents = spark.createDataFrame([("irse",), ("ponerse",)], "word string")
    made = enclitics.decompose(*_tables(spark))
    got = {r["word"]: (r["target"], r["tier"]) for r in enclitics.tiers(words, listed, made, parents).collect()}
    assert got["irse"] == ("irse", "keep") and got["ponerse"] == ("ponerse", "keep")
    assert got["alejarte"] == ("alejar", "merge") and got["córtala"] == ("corta", "merge") and got["dármelo"] == ("dar", "merge")
    assert got["llévamelo"] == ("llevar", "orphan") and "nunca" not in got and "luna" not in got
