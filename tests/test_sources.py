"""Readers and writers over temporary files."""

from __future__ import annotations

import gzip
import json

import pytest

from lexspark.sources import readers, writers


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_songs_and_pairs(spark, tmp_path):
    (tmp_path / "b1.json").write_text(json.dumps([{"id": "x", "title": "X", "lyrics": "la"}, {"id": "y", "title": "Y", "lyrics": "le"}]))
    assert rows(readers.songs(spark, f"{tmp_path}/b*.json"), "song_order", "id") == [(0, "x"), (1, "y")]
    (tmp_path / "p.tsv").write_text("hi\thola\nbad\n\tempty\nbye\tadiós\textra\n")
    assert rows(readers.pairs_tsv(spark, f"{tmp_path}/p.tsv"), "english", "target") == [("bye", "adiós"), ("hi", "hola")]


def test_parallel_lines_with_stride(spark, tmp_path):
    (tmp_path / "es").write_text("".join(f"es{i}\n" for i in range(10_000)))
    (tmp_path / "en").write_text("".join(f"en{i}\n" for i in range(10_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        both = readers.parallel_lines(spark, f"{tmp_path}/es", f"{tmp_path}/en").collect()
        some = readers.parallel_lines(spark, f"{tmp_path}/es", f"{tmp_path}/en", 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(both) == 10_000 and all(r["target"][2:] == r["english"][2:] == str(r["line_no"]) for r in both)
    assert sorted(r["line_no"] for r in some) == list(range(0, 10_000, 100))


DICTIONARY = [
    {"word": "casa", "pos": "noun", "senses": [{"glosses": ["house"]}, {"glosses": ["old"], "tags": ["obsolete"]}]},
    {"word": "casas", "pos": "noun", "senses": [{"glosses": ["plural of casa"], "form_of": [{"word": "casa"}]}]},
    {"word": "hablo", "pos": "verb", "senses": [{"glosses": ["form"], "form_of": [{"word": "hablar"}], "tags": ["first-person", "singular", "present", "indicative"]}]},
    {"word": "Ana", "pos": "name", "senses": [{"glosses": ["a name"]}]},
    {"word": "whisky", "pos": "noun", "senses": [{"glosses": ["whisky"]}], "etymology_templates": [{"name": "bor", "args": {"1": "es", "2": "en"}}]},
]


def test_dictionary(spark, tmp_path):
    path = str(tmp_path / "d.jsonl.gz")
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(d) + "\n" for d in DICTIONARY)
    entries, redirects = readers.wiktionary(spark, path)
    assert ("casa", ["house"]) in rows(entries, "word", "glosses") and "casas" not in [r[0] for r in rows(entries, "word")]
    assert ("casas", "casa", 1) in rows(redirects, "word", "base", "place")
    assert rows(readers.name_only_words(spark, path), "word") == [("Ana",)]
    assert rows(readers.morphology_layer(spark, path), "word", "lemma", "mood", "tense") == [("hablo", "hablar", "indicative", "present")]
    assert rows(readers.loanwords(spark, path, "en"), "word", "pos") == [("whisky", "noun")]


def test_lists(spark, tmp_path):
    (tmp_path / "f.csv").write_text("word,lemma,ppm\nes,ser,9.7\nes,es,3\nsí,sí,2.2\n")
    assert rows(readers.inventory_csv(spark, f"{tmp_path}/f.csv"), "word", "ppm", "lemmas") == [("es", 9, "es,ser"), ("sí", 2, "sí")]
    (tmp_path / "l.tsv").write_text("ortho\tlemma\tfreq\nvais\taller\t5\nva\taller\t9\nchat\tchat\t7\n")
    assert rows(readers.lexicon_ranks(spark, f"{tmp_path}/l.tsv", 2), "key", "rank") == [("aller", 1), ("chat", 2), ("va", 1)]
    (tmp_path / "j.csv").write_text("infinitive,infinitive_english\nir,to go\nir,to go\n")
    assert rows(readers.glosses_csv(spark, f"{tmp_path}/j.csv"), "infinitive", "gloss") == [("ir", "to go")]
    (tmp_path / "t.tsv").write_text('tconst\ttitle\nt1\t"A\nt2\t\\N\nt3\tC\n')
    wanted = spark.createDataFrame([("t1",), ("t2",)], "tconst string")
    assert rows(readers.title_basics(spark, f"{tmp_path}/t.tsv", wanted), "tconst", "title") == [("t1", '"A'), ("t2", None)]


def test_imports(spark, tmp_path):
    (tmp_path / "plain.txt").write_bytes("﻿hablo\r\n\r\nsí\r\n".encode())
    assert rows(readers.vocabulary_import(spark, f"{tmp_path}/plain.txt"), "line", "surface") == [(1, "hablo"), (3, "sí")]
    (tmp_path / "c.csv").write_text('word,lemma,last_incorrect\n"a ""b"", c",x,2024-01-01\nhola,,\n')
    got = rows(readers.vocabulary_import(spark, f"{tmp_path}/c.csv"), "line", "surface", "lemma", "last_wrong")
    assert got == [(2, 'a "b", c', "x", "2024-01-01"), (3, "hola", None, None)]


def test_jsonl_and_assignments(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","v":2}\n{"id":"1","v":2}\n')
    assert readers.jsonl(spark, f"{tmp_path}/a.jsonl", "id string, v int").count() == 1
    (tmp_path / "b.jsonl").write_text('{"id":"1","v":2}\n{"id":"1","v":3}\n')
    with pytest.raises(ValueError, match="different rows"):
        readers.jsonl(spark, f"{tmp_path}/b.jsonl", "id string, v int")
    (tmp_path / "s.json").write_text(json.dumps({"es": {"m": [{"sense": "a1", "examples": [0, 2], "confidence": 0.5}]}}))
    assert rows(readers.assignments(spark, f"{tmp_path}/s.json"), "word", "method", "sense", "example_idx") == [("es", "m", "a1", 0), ("es", "m", "a1", 2)]


def test_lrc(spark):
    df = spark.createDataFrame([(1, "[00:01.50]uno\n[00:01.50]dos\n[00:03.250]\n[01:00]tres", 70_000)], "id int, synced string, ms_all int")
    got = rows(readers.lrc(df, "id", "synced", "ms_all"), "ms", "end_ms", "text")
    assert got == [(1500, 3250, "dos"), (1500, 3250, "uno"), (60000, 70000, "tres")]


def test_page_payloads(spark):
    page = 'x window.DATA = {"headword":"ir","links":[{"word":"andar","relationship":1}],"senses":[{"pos":"verb","translations":["go","leave"]}]}; y'
    df = spark.createDataFrame([(1, page), (2, "none")], "page_id int, html string")
    assert rows(readers.thesaurus(df, "page_id", "html"), "headword", "pos", "translation") == [("ir", "verb", "go"), ("ir", "verb", "leave")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    first, again = (writers.write_jsonl(d, f"{tmp_path}/{n}", "id") for n, d in (("x", df), ("y", df.repartition(3))))
    assert first == again and first[0] == 2
    assert [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/x").orderBy("value").collect()] == [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]
    writers.archive(df, f"{tmp_path}/store", "r1")
    writers.archive(df.where("id = 1"), f"{tmp_path}/store", "r2")
    assert writers.latest(spark, f"{tmp_path}/store").count() == 1
    with pytest.raises(Exception, match="exists"):
        writers.archive(df, f"{tmp_path}/store", "r1")
    assert writers.read_version(spark, f"{tmp_path}/x") == 0
    writers.write_sidecar(spark, f"{tmp_path}/x", "count", 3)
    assert writers.read_version(spark, f"{tmp_path}/x") == 3
    writers.write_shards(spark.range(1, 11).withColumnRenamed("id", "rank"), f"{tmp_path}/shards", "rank", 4)
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().orderBy("shard").select("count").collect()] == [4, 4, 2]
    cards = spark.createDataFrame([("c", 1, "s2", ["e3"]), ("c", 0, "s1", ["e1", "e2"])], "card string, pos int, sense string, examples array<string>")
    writers.write_split(cards, f"{tmp_path}/index", f"{tmp_path}/examples")
    assert spark.read.json(f"{tmp_path}/index").first()["senses"] == ["s1", "s2"]
    assert spark.read.json(f"{tmp_path}/examples").first()["m"] == [["e1", "e2"], ["e3"]]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert rows(writers.manifest(spark, f"{tmp_path}/*.bin"), "bytes") == [(3,)]
