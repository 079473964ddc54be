"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import (
    collocations,
    decontam,
    filter_audit,
    line_dedup,
    media,
    mixing,
    near_dedup,
    quality,
    quality_rules,
    secrets,
    token_counts,
    toxicity,
    url_filter,
)
from lexspark.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "severity", "grade", "p_toxic", "toxic")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    marked = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_shingles", "component_id", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without chunks of lines that repeat."""
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "removed_lines", "removed_words")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' texts stored as media and read back."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside benchmark windows."""
    marked = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    marked = mixing.mix(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "size", "source_size", "target", "taken", "repetitions")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, for each source, order and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the rules' model on all documents."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "posterior")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scans": op3_secret_scans,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_mix_sources": op10_mix_sources,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_rules": op13_quality_rules,
}

UPPER, LOWER = decontam.UPPER, decontam.LOWER
SPACED = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _near_dedup_sql() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) c USING (doc_id)"""


def _decontamination_sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
 win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w[j:j + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM i WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT len(win) AS k FROM win), runs AS (SELECT doc_id, j, k, w[j:j + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, sizes WHERE len(w) >= k)),
 hits AS (SELECT doc_id, j, k, item FROM runs JOIN win USING (win)), pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hits) GROUP BY 1),
 ids AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(pos.n, 0) > 0 AND {decontam.MAX_SHARE} * coalesce(pos.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""


def _url_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[0] != "block"))
    cases, verdicts = [], []
    for action, rule in rules:
        host, _, path = rule.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases.append(f"WHEN {fits} THEN '{rule}'")
        verdicts.append(f"WHEN rule = '{rule}' THEN '{action}'")
    hit = lambda w: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){w}($|[^a-z0-9])') AS INT)"
    return f"""WITH u AS (SELECT page_id, url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u), p AS (SELECT *, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
 r AS (SELECT *, CASE {' '.join(cases)} END AS rule, {' + '.join(map(hit, url_filter.STRICT))} AS strict_hits, {' + '.join(map(hit, url_filter.SOFT))} AS soft_hits FROM p)
SELECT page_id, host, path, rule, CASE {' '.join(verdicts)} WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits FROM r"""


def _mixing_sql() -> str:
    cycle = f"[{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1]"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), w AS (SELECT *, {cycle} AS weight, source_size * {mixing.MAX_EPOCHS} AS cap FROM s),
 l AS (SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS rest, (SELECT CAST(sum(weight) AS BIGINT) FROM w) - CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, CAST(cap AS DOUBLE) * weights >= CAST(rest AS DOUBLE) * weight AS free FROM l), b AS (SELECT rest, weights FROM f WHERE free ORDER BY cap / weight, source IS NULL, source LIMIT 1),
 g AS (SELECT source, source_size, CASE WHEN free THEN weight * (SELECT rest FROM b) / (SELECT weights FROM b) ELSE CAST(cap AS DOUBLE) END AS target FROM f),
 n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS whole FROM g), t AS (SELECT *, target - whole * source_size AS need FROM n),
 k AS (SELECT source, key, size, sum(size) AS words, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d GROUP BY source, key, size),
 x AS (SELECT d.doc_id, d.size, t.source_size, t.target, whole, CASE WHEN need <= 0 OR ahead >= need THEN 0.0 WHEN ahead + words <= need THEN 1.0 ELSE CAST((need - ahead) / words AS DOUBLE) END AS extra
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key AND k.size = d.size)
SELECT doc_id, size, source_size, target, CAST(size * whole + floor(size * extra) AS BIGINT) AS taken, whole + extra AS repetitions FROM x"""


def _collocations_sql() -> str:
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), c AS (SELECT *, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
 h AS (SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
 cuts AS (SELECT h.lang, h.phrase, h.k, h.a, j, x.f AS l, y.f AS r FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.head AND x.k = j JOIN f y ON y.lang = h.lang AND y.phrase = h.tail AND y.k = h.k - j),
 best AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, j) = 1),
 inner_ AS (SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS s FROM c WHERE k = 3) GROUP BY ALL),
 left_ AS (SELECT best.* FROM best LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.phrase = best.phrase AND best.k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM left_ JOIN totals USING (lang) QUALIFY rank <= 2000"""


def _audit_sql() -> str:
    letters = "unnest(['A', 'B', 'C', 'D', 'E'])"
    order = " || ".join(f"l{i}.l" for i in range(1, 6))
    tables = ", ".join(f"l l{i}" for i in range(1, 6))
    return f"""WITH l AS (SELECT {letters} AS l), orders AS (SELECT {order} AS filter_order FROM {tables} WHERE len(list_distinct([{', '.join(f'l{i}.l' for i in range(1, 6))}])) = 5),
 t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '{SPACED}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
 y AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
 d AS (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM w LEFT JOIN y USING (doc_id)),
 s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
 e AS (SELECT part, filter_order, CAST(step AS INT) AS step, own, contains(fails, own) AS hit, len(translate(fails, before, '')) < len(fails) AS gone, fails = own AS only_, good, bad FROM d, s),
 c AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT hit) AS kept, count(*) FILTER (hit AND NOT gone) AS removed, count(*) FILTER (hit AND gone) AS redundant,
  count(*) FILTER (only_) AS unique_fails, count(*) FILTER (hit AND NOT gone AND good) AS good_lost, count(*) FILTER (hit AND NOT gone AND bad) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c"""


ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": _near_dedup_sql(),
    "op8_benchmark_decontamination": _decontamination_sql(),
    "op9_url_filters": _url_sql(),
    "op10_mix_sources": _mixing_sql(),
    "op11_phrase_collocations": _collocations_sql(),
    "op12_filter_audit": _audit_sql(),
}
