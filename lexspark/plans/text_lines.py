"""Queries on lines, tokens and phrases (TOK, PRJ, FLT, AGG01-05, AGG34, WIN01, WIN09, WIN19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import lines as L
from lexspark.operators import selection as S
from lexspark.session import table

TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"
LINES = (
    "lines AS (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM "
    "(SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"
)
TOKENS = f"{LINES}, toks AS (SELECT *, regexp_extract_all(lower(line), '{TOKEN}') AS toks FROM lines)"
DISTINCT = f"{TOKENS}, dl AS (SELECT doc_id, array_to_string(toks, ' ') AS line_key, min(line_no) AS line_no FROM toks WHERE len(toks) > 0 GROUP BY ALL)"
WORDS = f"{DISTINCT}, words AS (SELECT doc_id, unnest(string_split(line_key, ' ')) AS word FROM dl)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def word_count_once_per_doc(spark, sf_dir):
    """TOK01, AGG01: words of each document's different lines."""
    return L.word_counts(_docs(spark, sf_dir)).select("word", "corpus_count")


def lyric_tokens(spark, sf_dir):
    """TOK01: counting tokens of lines in which some words are sung short: 'tamos, la-la-la."""
    sung = F.concat(F.regexp_replace("line", r"\\b(est|de)([a-z]+)", "'t$2"), F.lit(" 'toy la-la-LA post-guerra"))
    rows = L.lines(_docs(spark, sf_dir)).select(F.explode(T.lyric_tokens(sung)).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


def song_count(spark, sf_dir):
    """AGG02: documents of each word."""
    return L.word_counts(_docs(spark, sf_dir)).select("word", "doc_count")


def stable_rank(spark, sf_dir):
    """WIN09: a rank by count, then word."""
    return S.ranked(L.word_counts(_docs(spark, sf_dir)), "corpus_count", "word").select("word", "rank")


def line_score(spark, sf_dir):
    """FLT02: points of each line."""
    toks = L.tokenised(_docs(spark, sf_dir))
    return toks.select("doc_id", "line_no", T.line_score(F.col("toks")).alias("score"), T.good_context(F.col("toks")).alias("good"))


CONNECTORS = "'que','pero','si','cuando','porque','aunque','con','sin','me','te','se','nos','ya','pa''','pal','pa','al','del','la','el','los','las'"
LINE_SCORE = f"""(CASE WHEN len(toks) BETWEEN 7 AND 16 THEN 3 WHEN len(toks) BETWEEN 5 AND 20 THEN 1 ELSE 0 END
  + CASE WHEN list_has_any(toks, [{CONNECTORS}]) THEN 1 ELSE 0 END - CASE WHEN len(toks) > 24 THEN 2 ELSE 0 END)"""
GOOD = "(len(toks) >= 5 AND NOT (len(toks) >= 6 AND len(list_distinct(toks)) <= 2))"


def line_gate_reason(spark, sf_dir):
    """FLT04: the first of ordered reasons to reject a line; null passes."""
    toks = L.lines(_docs(spark, sf_dir)).withColumn("toks", T.tokens(F.col("line")))
    n, line = F.size("toks"), F.col("line")
    reason = (
        F.when(F.length(F.trim(line)) == 0, "empty")
        .when(F.length(line) < 24, "short")
        .when(F.length(line) > 300, "long")
        .when(line.rlike(r"https?://|www\."), "link")
        .when(line.rlike(r"[0-9]"), "digits")
        .when(line.rlike(r"[|#$%&*@^~<>]"), "symbols")
        .when(line == F.upper(line), "shouting")
        .when(line.rlike(r"\.\.\."), "ellipsis")
        .when(n < 5, "few tokens")
        .when(n > 40, "many tokens")
        .when(F.size(F.array_distinct("toks")) * 2 < n, "repeats")
    )
    return toks.select("doc_id", "line_no", reason.alias("reason"))


def gate_tallies(spark, sf_dir):
    """AGG35: rejected and accepted, by line and by line and word."""
    gated = line_gate_reason(spark, sf_dir).join(L.tokenised(_docs(spark, sf_dir)).select("doc_id", "line_no", F.size(F.array_distinct("toks")).alias("w")), ["doc_id", "line_no"], "left")
    reason = F.coalesce("reason", F.lit("accepted"))
    return gated.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_lines"), F.sum(F.coalesce("w", F.lit(0))).alias("n_line_words"))


GATE = f"""{TOKENS}, gated AS (SELECT doc_id, line_no, toks, CASE WHEN length(trim(line, ' ')) = 0 THEN 'empty' WHEN length(line) < 24 THEN 'short'
  WHEN length(line) > 300 THEN 'long' WHEN regexp_matches(line, 'https?://|www\\.') THEN 'link' WHEN regexp_matches(line, '[0-9]') THEN 'digits'
  WHEN regexp_matches(line, '[|#$%&*@^~<>]') THEN 'symbols' WHEN line = upper(line) THEN 'shouting' WHEN regexp_matches(line, '\\.\\.\\.') THEN 'ellipsis'
  WHEN len(toks) < 5 THEN 'few tokens' WHEN len(toks) > 40 THEN 'many tokens' WHEN len(list_distinct(toks)) * 2 < len(toks) THEN 'repeats' END AS reason FROM toks)"""


def junk_token(spark, sf_dir):
    """FLT18: tokens that look like gibberish."""
    counts = L.word_counts(_docs(spark, sf_dir))
    return counts.where(T.gibberish(F.col("word"))).select("word", "corpus_count")


FOLD = "translate(lower(trim(%s, ' ')), 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc')"
FOLD_WORD = FOLD % "word"


def accent_fold(spark, sf_dir):
    """PRJ08: words by their folded form, which identity never uses."""
    counts = L.word_counts(_docs(spark, sf_dir)).withColumn("folded", T.fold_accents(F.col("word")))
    return counts.groupBy("folded").agg(F.count("*").alias("forms"), F.sum("corpus_count").alias("uses"))


def text_normalize(spark, sf_dir):
    """PRJ01 and IDN03: a content id of the normalised text."""
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.sha2(T.normalize_text(F.col("text")), 256), 1, 12).alias("content_id"))


def adlib_strip(spark, sf_dir):
    """PRJ04."""
    stripped = L.lines(_docs(spark, sf_dir)).select("doc_id", "line_no", "line", T.strip_adlibs(F.col("line")).alias("clean"))
    return stripped.where("clean <> trim(line)").select("doc_id", "line_no", "clean")


def ngram_counts(spark, sf_dir):
    """TOK06, AGG03."""
    return L.ngram_counts(_docs(spark, sf_dir)).where("count >= 3")


NGRAMS = f"""{LINES}, chunks AS (SELECT DISTINCT doc_id, array_to_string(toks, ' ') AS line_key FROM (SELECT doc_id, regexp_extract_all(chunk, '{TOKEN}') AS toks
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(line), '[.,;:!?()\\[\\]\\"|]+')) AS chunk FROM lines)) WHERE len(toks) >= %d),
 grams AS (SELECT doc_id, line_key, n, array_to_string(t[i:i + n - 1], ' ') AS ngram FROM (SELECT doc_id, line_key, t, n, unnest(range(1, len(t) - n + 2)) AS i
  FROM (SELECT doc_id, line_key, string_split(line_key, ' ') AS t FROM chunks), (SELECT unnest([%s]) AS n))),
 counts AS (SELECT n, ngram, count(*) AS count, count(DISTINCT doc_id) AS doc_count, count(DISTINCT (doc_id, line_key)) AS line_count FROM grams GROUP BY ALL)"""
PMI = f"""WITH {NGRAMS % (1, "1, 2, 3, 4, 5")}, totals AS (SELECT n, sum(count) AS total FROM counts GROUP BY n), kept AS (SELECT n, ngram, count, doc_count, unnest(string_split(ngram, ' ')) AS word
  FROM counts WHERE n > 1 AND count >= 4 AND doc_count >= 3), logs AS (SELECT k.n, k.ngram, k.count, k.doc_count, sum(log2(o.count)) AS logs FROM kept k JOIN counts o ON o.n = 1 AND o.ngram = k.word GROUP BY ALL),
 pmi AS (SELECT l.n, ngram, count, doc_count, round(log2(count) - log2(t.total) - logs + l.n * log2(w.total), 1) AS pmi FROM logs l JOIN totals t ON t.n = l.n JOIN totals w ON w.n = 1)
SELECT * FROM pmi WHERE pmi >= %s"""


def pmi_phrases(spark, sf_dir):
    """AGG04."""
    return L.pmi_phrases(_docs(spark, sf_dir))


def caps_stats(spark, sf_dir):
    """AGG05."""
    return L.caps_stats(_docs(spark, sf_dir))


CAPS = f"""{LINES}, surf AS (SELECT unnest(s) AS surface, unnest(range(len(s))) AS i FROM (SELECT regexp_extract_all(line, '{TOKEN}') AS s FROM lines)),
 caps AS (SELECT lower(surface) AS word, count(*) AS total, count(*) FILTER (regexp_matches(surface, '^\\p{{Lu}}') AND i > 0) AS midcap,
  count(*) FILTER (regexp_matches(surface, '^\\p{{Lu}}') AND i = 0) AS firstcap FROM surf GROUP BY 1),
 rated AS (SELECT *, CASE WHEN midcap > 0 AND total > firstcap THEN round(midcap / (total - firstcap), 3) ELSE 0.0 END AS rate FROM caps)"""


def caps_proper_noun(spark, sf_dir):
    """FLT07: capital inside lines at a rate of 0.65 or more, three times or more."""
    return L.caps_stats(_docs(spark, sf_dir)).where("rate >= 0.65 and midcap >= 3").select("word", "midcap", "rate")


def corpus_proper_nouns(spark, sf_dir):
    """AGG34: never lower-case inside lines, capital three times or more, unranked (not among the 1,000 first)."""
    stats = L.caps_stats(_docs(spark, sf_dir)).where("midcap >= 3 and total - firstcap = midcap")
    ranked = stable_rank(spark, sf_dir).where("rank <= 1000")
    return stats.join(ranked, "word", "left_anti").select("word", "midcap")


def top3_lines_per_word_doc(spark, sf_dir):
    """WIN01."""
    return L.top_lines(_docs(spark, sf_dir))


def repetition_lines(spark, sf_dir):
    """FLT22: lines of one repeated token."""
    toks = L.tokenised(_docs(spark, sf_dir)).where(T.repetition(F.col("toks")) & (F.size("toks") > 1))
    return toks.select("doc_id", "line_no", F.size("toks").alias("n"))


def sort_letters(spark, sf_dir):
    """PRJ18: words by their sorted letters: anagrams."""
    words = L.word_counts(_docs(spark, sf_dir)).select(T.sort_letters(F.col("word")).alias("letters"))
    return words.groupBy("letters").agg(F.count("*").alias("forms")).where("forms > 1")


def nesting_depth(spark, sf_dir):
    """FUN09: deepest brackets in page sources' styles and texts."""
    pages = table(spark, sf_dir, "pages")
    marked = F.translate("html", "<>", "()")
    return pages.select("page_id", T.nesting_depth(F.regexp_replace(marked, "[^()]", "")).alias("depth"))


def html_component(spark, sf_dir):
    """SRC17: the first title of a page and its language."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("")).alias("lang"),
    )


def cloze(spark, sf_dir):
    """TOK10: a document split at the first whole-word "the"; none: null."""
    pattern = r"(?i)^(.*?)(?<![\p{L}\p{N}])(the)(?![\p{L}\p{N}])(.*)$"
    firsts = L.lines(_docs(spark, sf_dir)).where("line_no = 0")
    got = F.regexp_extract("line", pattern, 2) != ""
    before = F.when(got, F.regexp_extract("line", pattern, 1))
    return firsts.select("doc_id", before.alias("before"), F.when(got, F.regexp_extract("line", pattern, 3)).alias("after"))


def stop_word_language(spark, sf_dir):
    """FLT03: lines of four tokens or more, 25 % of them of one language's commonest words."""
    lists = {"de": "der die und das ist mit", "en": "the of and to is that", "es": "de que la el los se", "fr": "le la de les et que"}
    toks = L.tokenised(_docs(spark, sf_dir)).where("size(toks) >= 4")
    share = {k: F.expr(f"size(filter(toks, t -> t IN ({', '.join(repr(x) for x in v.split())})))") for k, v in lists.items()}
    best = F.greatest(*share.values())
    lang = F.when(best * 4 < F.size("toks"), None)
    for k, n in share.items():
        lang = lang.when(n == best, k)
    return toks.select("doc_id", lang.alias("lang")).groupBy("doc_id", "lang").agg(F.count("*").alias("n_lines"))


def _language_oracle() -> str:
    lists = {"de": "der die und das ist mit", "en": "the of and to is that", "es": "de que la el los se", "fr": "le la de les et que"}
    n = {k: f"len(list_filter(toks, lambda t: t IN ({', '.join(repr(x) for x in v.split())})))" for k, v in lists.items()}
    cases = " ".join(f"WHEN {k} = greatest(de, en, es, fr) THEN '{k}'" for k in lists)
    return f"""WITH {TOKENS}, c AS (SELECT doc_id, len(toks) AS n, {', '.join(f'{v} AS {k}' for k, v in n.items())} FROM toks WHERE len(toks) >= 4)
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) * 4 < n THEN NULL {cases} END AS lang, count(*) AS n_lines FROM c GROUP BY ALL"""


QUERIES = {
    f.__name__: f
    for f in (
        word_count_once_per_doc, lyric_tokens, song_count, stable_rank, line_score, line_gate_reason, gate_tallies, junk_token, accent_fold, text_normalize,
        adlib_strip, ngram_counts, pmi_phrases, caps_stats, caps_proper_noun, corpus_proper_nouns, top3_lines_per_word_doc, repetition_lines,
        sort_letters, nesting_depth, html_component, cloze, stop_word_language,
    )
}

COUNTED = f"WITH {WORDS}, counted AS (SELECT word, count(*) AS corpus_count, count(DISTINCT doc_id) AS doc_count FROM words GROUP BY word)"
RANKED = f"{COUNTED}, ranked AS (SELECT word, row_number() OVER (ORDER BY corpus_count DESC, word) AS rank FROM counted)"
ORACLES = {
    "word_count_once_per_doc": f"{COUNTED} SELECT word, corpus_count FROM counted",
    "song_count": f"{COUNTED} SELECT word, doc_count FROM counted",
    "stable_rank": f"{RANKED} SELECT * FROM ranked",
    "line_score": f"WITH {TOKENS} SELECT doc_id, line_no, {LINE_SCORE} AS score, {GOOD} AS good FROM toks WHERE len(toks) > 0",
    "line_gate_reason": f"WITH {GATE} SELECT doc_id, line_no, reason FROM gated",
    "gate_tallies": f"WITH {GATE} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_lines, sum(len(list_distinct(toks))) AS n_line_words FROM gated GROUP BY 1",
    "junk_token": f"""{COUNTED} SELECT word, corpus_count FROM (SELECT *, {FOLD_WORD} AS p FROM counted) WHERE regexp_matches(p, '[bcdfghjklmnpqrstvwxz]{{6}}')
  OR (length(p) >= 3 AND NOT regexp_matches(p, '[aeiouy]')) OR len(list_filter(range(1, length(p) - 2), lambda i: p[i] = p[i + 1] AND p[i] = p[i + 2] AND p[i] = p[i + 3])) > 0""",
    "accent_fold": f"{COUNTED} SELECT {FOLD_WORD} AS folded, count(*) AS forms, sum(corpus_count) AS uses FROM counted GROUP BY 1",
    "text_normalize": """SELECT doc_id, left(sha256(translate(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '‘`–—еаорсхі' || chr(8197) || chr(8287) || chr(8202) || chr(12288) || chr(8203) || chr(65279),
  '’’--eaopcxi    ')), 12) AS content_id FROM documents""",
    "adlib_strip": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, line, trim(regexp_replace(regexp_replace(regexp_replace(line, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'),
  '(?i)\\b[a-z]{{1,3}}(?:-[a-z]{{1,3}})+\\b', ' ', 'g'), ' +', ' ', 'g'), ' ') AS clean FROM lines) SELECT doc_id, line_no, clean FROM c WHERE clean <> trim(line, ' ')""",
    "ngram_counts": f"WITH {NGRAMS % (2, '2, 3, 4, 5')} SELECT * FROM counts WHERE count >= 3",
    "pmi_phrases": PMI % "15.0",
    "caps_stats": f"WITH {CAPS} SELECT * FROM rated",
    "caps_proper_noun": f"WITH {CAPS} SELECT word, midcap, rate FROM rated WHERE rate >= 0.65 AND midcap >= 3",
    "corpus_proper_nouns": f"{RANKED}, {CAPS.replace(LINES + ', ', '')} SELECT word, midcap FROM rated WHERE midcap >= 3 AND total - firstcap = midcap AND word NOT IN (SELECT word FROM ranked WHERE rank <= 1000)",
    "top3_lines_per_word_doc": f"""WITH {DISTINCT}, sc AS (SELECT doc_id, line_no, {LINE_SCORE} AS score, {GOOD} AS good, unnest(list_distinct(toks)) AS word FROM (SELECT *, string_split(line_key, ' ') AS toks FROM dl)),
 rk AS (SELECT word, doc_id, line_no, score, good, row_number() OVER (PARTITION BY word, doc_id ORDER BY good DESC, score DESC, line_no) AS rank, bool_or(good) OVER (PARTITION BY word, doc_id) AS any_good FROM sc)
SELECT word, doc_id, line_no, score, rank FROM rk WHERE rank <= 3 AND (good OR NOT any_good)""",
    "repetition_lines": f"WITH {TOKENS} SELECT doc_id, line_no, len(toks) AS n FROM toks WHERE len(toks) > 1 AND len(list_distinct(toks)) = 1",
    "sort_letters": f"{COUNTED} SELECT array_to_string(list_sort(string_split(word, '')), '') AS letters, count(*) AS forms FROM counted GROUP BY 1 HAVING count(*) > 1",
    "html_component": "SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') AS lang FROM pages",
    "stop_word_language": _language_oracle(),
}
