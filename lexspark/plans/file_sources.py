"""Queries through files: each writes rows in a reader's format to the shared folder and reads them back (SRC01-15, SRC17-18, SNK02-04, SNK08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.session import scratch, table
from lexspark.sources import readers, writers


def _text(df: DataFrame, name: str) -> str:
    """The path of the rows' only column as text files."""
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their class, the first word of their type."""
    return table(spark, sf_dir, "part").withColumn("p_class", F.split("p_type", " ")[0])


def _json(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.json(path)
    return path


def _csv(df: DataFrame, name: str, sep: str = ",", header: bool = True) -> str:
    path = scratch(df.sparkSession, name)
    df.write.csv(path, sep=sep, header=header, nullValue="\\N" if sep == "\t" else "", emptyValue="", quote='"')
    return path


def song_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01: the nations of each region as a file with an array of songs."""
    song = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.lower("n_name").alias("lyrics"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(song))).alias("value"))
    path = scratch(spark, "songs")
    rows.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.songs(spark, f"{path}/*/*").select("id", "title", "lyrics", "song_order")


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC02: part names and types between tabs; some rows lack a field, some an empty side."""
    kind = F.pmod("p_partkey", F.lit(10))
    line = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat("p_name", F.lit("\t "))).otherwise(F.concat_ws("\t", "p_name", F.concat(F.lit(" "), "p_type"), "p_brand"))
    return readers.pairs_tsv(spark, _text(table(spark, sf_dir, "part").select(line), "pairs")).groupBy("english", "target").agg(F.count("*").alias("n"))


def subtitle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03, SRC04: two files aligned by line, of which every (total / 500)-th line is taken."""
    orders = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    target = _text(orders.select(F.concat_ws(" ", F.lit("pedido"), "o_orderkey")), "target")
    english = _text(orders.select(F.concat_ws(" ", F.lit("order"), "o_orderkey", "o_orderstatus")), "english")
    return readers.parallel_lines(spark, target, english, 500)


def _dictionary(spark: SparkSession, sf_dir: str) -> str:
    """Entries as JSON lines: a word of each part, with a sense that may be archaic, and a form of its brand."""
    p = table(spark, sf_dir, "part")
    strings = lambda *c: F.array(*c).cast("array<string>")
    own = F.struct(strings(F.col("p_type")).alias("glosses"), F.when(F.col("p_size") > 40, strings(F.lit("archaic"))).otherwise(strings()).alias("tags"),
                   F.lit(None).cast("array<struct<word:string>>").alias("form_of"))
    tags = strings(F.lit("form-of"), F.when(F.col("p_size") % 2 == 0, "indicative").otherwise("subjunctive"), F.lit("present"), F.lit("first-person"), F.lit("singular"))
    form = F.struct(strings(F.lit("form")).alias("glosses"), tags.alias("tags"), F.array(F.struct(F.col("p_brand").alias("word"))).alias("form_of"))
    senses = F.when(F.col("p_size") % 3 == 0, F.array(own)).when(F.col("p_size") % 3 == 1, F.array(form)).otherwise(F.array(own, form))
    loan = F.struct(F.when(F.col("p_size") % 2 == 0, "bor").otherwise("inh").alias("name"), F.create_map(F.lit("1"), F.lit("es"), F.lit("2"), F.lit("en")).alias("args"))
    pos = F.when(F.col("p_size") % 5 == 0, "name").when(F.col("p_size") % 2 == 0, "verb").otherwise("noun")
    word = F.concat_ws("-", "p_name", F.pmod("p_partkey", F.lit(200)))
    return _json(p.select(word.alias("word"), pos.alias("pos"), F.lit("es").alias("lang_code"), senses.alias("senses"), F.array(loan).alias("etymology_templates")), "dictionary")


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC05: real senses of each word and part of speech, and their number."""
    entries, _ = readers.wiktionary(spark, _dictionary(spark, sf_dir))
    return entries.select("word", "pos", F.size("glosses").alias("n"), F.array_join(F.array_sort("glosses"), "|").alias("glosses"))


def dictionary_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC05: bases of words that are only forms."""
    _, redirects = readers.wiktionary(spark, _dictionary(spark, sf_dir))
    return redirects.select("word", "base").distinct()


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06: words all of whose entries are names."""
    return readers.name_only_words(spark, _dictionary(spark, sf_dir))


def verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07: mood, tense and person of verb forms."""
    return readers.morphology_layer(spark, _dictionary(spark, sf_dir))


def borrowed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC08: words whose every entry is borrowed from English."""
    return readers.loanwords(spark, _dictionary(spark, sf_dir), "en")


def frequency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC09: the highest frequency of each name, and its brands."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_brand").alias("lemma"), (F.col("p_size") + F.lit(0.75)).alias("ppm"))
    return readers.inventory_csv(spark, _csv(rows, "inventory"))


def frequency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10: ranks of forms and lemmas by summed frequency."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("ortho"), F.col("p_brand").alias("lemma"), F.col("p_size").alias("freq"))
    return readers.lexicon_ranks(spark, _csv(rows, "lexicon", "\t"), 40)


def verb_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: a gloss for each infinitive."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("infinitive"), F.concat_ws(", ", F.lit("to"), "p_type").alias("infinitive_english"))
    return readers.glosses_csv(spark, _csv(rows, "glosses"))


def wanted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: customers with orders as titles, with \\N for a low balance."""
    year = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("string"))
    path = _csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tconst"), F.col("c_name").alias("primaryTitle"), year.alias("startYear")), "titles", "\t")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tconst")).distinct()
    return readers.title_basics(spark, path, wanted).select("tconst", "primaryTitle", F.col("startYear").cast("int").alias("startYear"))


def imported_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: a tab-separated list under a header of other names, in two folders, by its lines."""
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.concat_ws("\t", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.format_string("2024-01-%02d", (F.pmod("p_size", F.lit(28)) + 1).cast("int"))).alias("value")
    )
    head = spark.createDataFrame([("Entry\tBase\tLast Correct",)], "value string")
    path = scratch(spark, "import")
    head.coalesce(1).write.text(f"{path}/a")
    rows.write.text(f"{path}/b")
    return readers.vocabulary_import(spark, f"{path}/*")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14: events as JSON lines, some twice."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "user_id")
    return readers.jsonl(spark, _json(events.union(events.where("id % 7 = 0")), "events"), "id long, event_type string, user_id long")


def sense_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: senses of brands' parts, by method, as nested JSON, a file for each of some groups."""
    sense = F.struct(F.col("p_type").alias("sense"), F.array("p_partkey", "p_size").alias("examples"), (F.col("p_size") / 100).alias("confidence"))
    rows = _parts(spark, sf_dir).groupBy("p_brand", "p_class").agg(F.array_sort(F.collect_list(sense)).alias("items"))
    each = rows.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_class", "items"))).alias("m"))
    path = scratch(spark, "assignments")
    each.select("p_brand", F.to_json(F.create_map("p_brand", "m")).alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(path)
    found = readers.assignments(spark, f"{path}/*/*")
    return found.groupBy("word", "method").agg(F.count("*").alias("n"), F.sum("example_idx").alias("examples"), F.round(F.sum("confidence"), 4).alias("confidence"), F.max("ord").alias("last"))


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, SRC18: `window.DATA = {...};` in pages; none where the headword or the links are empty."""
    link = F.array(F.struct(F.col("p_type").alias("word"), F.lit(2).alias("relationship")))
    links = F.when(F.col("p_size") > 5, link).otherwise(F.array().cast("array<struct<word:string,relationship:int>>"))
    senses = F.array(F.struct(F.lower("p_class").alias("pos"), F.array("p_brand", "p_type").alias("translations")))
    data = F.to_json(F.struct(F.when(F.col("p_size") < 45, F.col("p_name")).otherwise("").alias("headword"), links.alias("links"), senses.alias("senses")))
    html = F.concat(F.lit("<html><script>var x = 1; window.DATA = "), data, F.lit("; var y = {};</script></html>"))
    path = scratch(spark, "pages")
    _parts(spark, sf_dir).select("p_partkey", html.alias("html")).write.parquet(path)
    return readers.thesaurus(spark.read.parquet(path), "p_partkey", "html")


def split_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK02: brands as cards; index and examples are read back and joined."""
    p = _parts(spark, sf_dir)
    cards = p.groupBy("p_brand", "p_class").agg(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))).alias("examples"))
    cards = cards.select(F.col("p_brand").alias("card"), F.col("p_class").alias("pos"), F.col("p_class").alias("sense"), "examples")
    index, examples = scratch(spark, "index"), scratch(spark, "examples")
    writers.write_split(cards, index, examples)
    both = spark.read.schema("card string, senses array<string>").json(index).join(spark.read.schema("card string, m array<array<string>>").json(examples), "card")
    return both.select("card", F.array_join("senses", ",").alias("senses"), F.array_join(F.transform("m", lambda x: F.size(x).cast("string")), ",").alias("sizes"))


def archived_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03, SNK04: of two archived runs the last is read, with its stamped version."""
    root, n = scratch(spark, "archive"), table(spark, sf_dir, "nation")
    writers.archive(n.where("n_nationkey < 3"), root, "first")
    writers.write_sidecar(spark, writers.archive(n, root, "second"), "nations", 7)
    version = writers.read_version(spark, f"{root}/runs/second") * 100 + writers.read_version(spark, f"{root}/runs/first")
    return writers.latest(spark, root).select("n_nationkey", "n_name", F.lit(version).alias("version"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK08: sizes and digests of one small file for each nation."""
    path = scratch(spark, "manifest")
    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    rows = writers.manifest(spark, f"{path}/*/*")
    return rows.select(F.regexp_extract("path", "n_nationkey=(\\d+)", 1).cast("long").alias("nation"), "bytes", "sha256")


QUERIES = {
    f.__name__: f
    for f in (
        song_batches, sentence_pairs, subtitle_pairs, dictionary_entries, dictionary_redirects, name_words, verb_forms, borrowed_words,
        frequency_inventory, frequency_ranks, verb_glosses, wanted_titles, imported_vocabulary, json_rows, sense_assignments, page_payloads,
        split_decks, archived_runs, file_manifest,
    )
}

ENTRY = """e AS (SELECT p_name || '-' || p_partkey % 200 AS word, CASE WHEN p_size % 5 = 0 THEN 'name' WHEN p_size % 2 = 0 THEN 'verb' ELSE 'noun' END AS pos, p_type, p_brand, p_size,
 p_size % 3 <> 1 AND p_size <= 40 AS is_real, p_size % 3 <> 0 AS is_form FROM part)"""
CLASSED = "(SELECT *, split_part(p_type, ' ', 1) AS p_class FROM part)"
ORACLES = {
    "song_batches": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, lower(n_name) AS lyrics, row_number() OVER (PARTITION BY n_regionkey ORDER BY CAST(n_nationkey AS VARCHAR)) - 1 AS song_order FROM nation",
    "sentence_pairs": "SELECT trim(p_name) AS english, p_type AS target, count(*) AS n FROM part WHERE p_partkey % 10 > 1 GROUP BY ALL",
    "subtitle_pairs": """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, greatest(1, count(*) OVER () // 500) AS stride FROM orders)
 SELECT line_no, 'pedido ' || o_orderkey AS target, 'order ' || o_orderkey || ' ' || o_orderstatus AS english FROM o WHERE line_no % stride = 0""",
    "dictionary_entries": f"WITH {ENTRY} SELECT word, pos, count(*) AS n, string_agg(p_type, '|' ORDER BY p_type) AS glosses FROM e WHERE is_real GROUP BY word, pos",
    "dictionary_redirects": f"WITH {ENTRY} SELECT DISTINCT word, p_brand AS base FROM e WHERE is_form AND (word, pos) NOT IN (SELECT (word, pos) FROM e WHERE is_real)",
    "name_words": f"WITH {ENTRY} SELECT word FROM e GROUP BY word HAVING bool_and(pos = 'name')",
    "verb_forms": f"WITH {ENTRY} SELECT DISTINCT word, p_brand AS lemma, CASE WHEN p_size % 2 = 0 THEN 'indicative' ELSE 'subjunctive' END AS mood, 'present' AS tense, 'first-person singular' AS person FROM e WHERE is_form AND pos = 'verb'",
    "borrowed_words": f"WITH {ENTRY} SELECT word, string_agg(DISTINCT pos, ',' ORDER BY pos) AS pos FROM e GROUP BY word HAVING bool_and(p_size % 2 = 0)",
    "frequency_inventory": "SELECT p_name AS word, max(p_size) AS ppm, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS lemmas FROM part GROUP BY p_name",
    "frequency_ranks": """WITH p AS (SELECT p_type AS ortho, p_brand AS lemma, sum(p_size) AS freq FROM part GROUP BY ALL), s AS (SELECT ortho, sum(freq) AS total, arg_max(lemma, (freq, lemma)) AS lemma FROM p GROUP BY ortho),
 r AS (SELECT *, row_number() OVER (ORDER BY total DESC, ortho) AS rank FROM s ORDER BY rank LIMIT 40) SELECT key, min(rank) AS rank FROM (SELECT ortho AS key, rank FROM r UNION ALL SELECT lemma, rank FROM r) GROUP BY key""",
    "verb_glosses": "SELECT p_name AS infinitive, 'to, ' || min(p_type) AS gloss FROM part GROUP BY p_name",
    "wanted_titles": 'SELECT CAST(c_custkey AS VARCHAR) AS tconst, c_name AS "primaryTitle", CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS INT) END AS "startYear" FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)',
    "imported_vocabulary": """SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS line, trim(p_name) AS surface, CASE WHEN p_size > 25 THEN p_brand END AS lemma, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS last_correct, NULL AS last_wrong FROM part""",
    "json_rows": "SELECT event_id AS id, event_type, user_id FROM events",
    "sense_assignments": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_class ORDER BY p_type, p_partkey, p_size) - 1 AS ord FROM {CLASSED})
 SELECT p_brand AS word, p_class AS method, 2 * count(*) AS n, sum(p_partkey + p_size) AS examples, round(2 * sum(p_size / 100), 4) AS confidence, max(ord) AS last FROM r GROUP BY ALL""",
    "page_payloads": f"SELECT p_partkey, p_name AS headword, lower(p_class) AS pos, unnest([p_brand, p_type]) AS translation FROM {CLASSED} WHERE p_size > 5 AND p_size < 45",
    "split_decks": f"""WITH c AS (SELECT p_brand, p_class, count(*) AS n FROM {CLASSED} GROUP BY ALL) SELECT p_brand AS card, string_agg(p_class, ',' ORDER BY p_class) AS senses, string_agg(CAST(n AS VARCHAR), ',' ORDER BY p_class) AS sizes FROM c GROUP BY 1""",
    "archived_runs": "SELECT n_nationkey, n_name, 700 AS version FROM nation",
    "file_manifest": "SELECT n_nationkey AS nation, strlen(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation",
}
