"""SQL of queries whose rules RE2 and DuckDB's lists express only by detours: no look-behind, no fold with a state."""

from __future__ import annotations

from lexspark.plans.text_lines import COUNTED, LINES, TOKENS

LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"
FOLD = "translate(lower(trim(%s)), 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc')"
CLOZE = r"(?i)^((?:.*?[^\p{L}\p{N}])??)(the)((?:[^\p{L}\p{N}].*)?)$"


def _lyric_tokens() -> str:
    sung = "line || ' ''toy la-la-LA post-guerra'"
    for short, whole in (
        ("tamos", "estamos"), ("tabas", "estabas"), ("tamo", "estamos"), ("taba", "estaba"), ("onde", "donde"), ("toy", "estoy"), ("tás", "estás"),
        ("tan", "están"), ("tán", "están"), ("tá", "está"), ("el", "del"), ("e", "de"),
    ):
        sung = rf"regexp_replace({sung}, '(?i)(^|[^{LETTERS}])[''’]{short}($|[^{LETTERS}])', '\1{whole}\2', 'g')"
    plain = rf"regexp_replace({sung}, '(?i)\b[{LETTERS}]{{1,3}}(?:-[{LETTERS}]{{1,3}})+\b', ' ', 'g')"
    return f"""WITH {LINES}, t AS (SELECT unnest(regexp_extract_all({plain}, '[{LETTERS}]+(?:''[{LETTERS}]+)*''?')) AS word FROM lines)
SELECT lower(word) AS word, count(*) AS n FROM t GROUP BY 1"""


ORACLES = {
    "lyric_tokens": _lyric_tokens(),
    "cloze": f"""WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents), m AS (SELECT doc_id, line, regexp_extract(line, '{CLOZE}', 2) <> '' AS got FROM f)
SELECT doc_id, CASE WHEN got THEN regexp_extract(line, '{CLOZE}', 1) END AS before, CASE WHEN got THEN regexp_extract(line, '{CLOZE}', 3) END AS after FROM m""",
    "nesting_depth": """WITH m AS (SELECT page_id, string_split(regexp_replace(translate(html, '<>', '()'), '[^()]', '', 'g'), '') AS c FROM pages), u AS (SELECT page_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM m),
 d AS (SELECT page_id, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM u)
SELECT page_id, CAST(greatest(0, max(coalesce(d, 0))) AS INT) AS depth FROM pages LEFT JOIN d USING (page_id) GROUP BY page_id""",
    "exact_surface": rf"""WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents), t AS (SELECT doc_id, line, regexp_extract_all(lower(line), '{TOKEN}')[3] AS third, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM f),
 p AS (SELECT *, '^((?:.*?[^\p{{L}}])??)(' || third || ')(?:$|[^\p{{L}}].*$)' AS p FROM t WHERE third IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_extract(low, p, 2) <> '' THEN substr(line, length(regexp_extract(low, p, 1)) + 1, length(third)) END AS surface FROM p""",
    "span_tiers": f"""WITH {TOKENS}, n AS (SELECT doc_id, line_no, toks[1] AS target, lead(toks) OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM toks WHERE len(toks) > 0),
 f AS (SELECT doc_id || ':' || line_no AS key, target, t, list_position(list_transform(t, lambda x: {FOLD % 'x'}), {FOLD % 'target'}) AS exact, list_filter(t, lambda x: x = target || 's' OR x = target || 'ed') AS form,
  list_filter(t, lambda x: length(target) >= 5 AND starts_with(x, left(target, 4))) AS stem FROM n WHERE t IS NOT NULL),
 s AS (SELECT key, CASE WHEN exact > 0 THEN t[exact] WHEN len(form) > 0 THEN form[1] ELSE list_min(list_transform(stem, lambda x: {{'n': length(x), 'x': x}})).x END AS surface,
  CASE WHEN exact > 0 THEN 1 WHEN len(form) > 0 THEN 2 WHEN len(stem) > 0 THEN 3 END AS tier FROM f)
SELECT * FROM s WHERE tier IS NOT NULL""",
    "vocal_artifacts": f"""{COUNTED}, k AS (SELECT word FROM counted WHERE doc_count >= 20), u AS (SELECT doc_id, line_no, unnest(toks) AS token, unnest(range(len(toks))) AS i FROM toks),
 g AS (SELECT u.*, k.word IS NOT NULL AS known, lag(token) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS before FROM u LEFT JOIN k ON k.word = token),
 a AS (SELECT *, coalesce(length(token) <= 3 AND length(before) <= 3 AND left(token, 1) = left(before, 1), false) AS same FROM g), r AS (SELECT *, same OR coalesce(lead(same) OVER (PARTITION BY doc_id, line_no ORDER BY i), false) AS run FROM a),
 l AS (SELECT token, CASE WHEN ends_with(token, '''') THEN 'adlib' WHEN run AND NOT known THEN 'stutter' WHEN length(token) >= 3 AND ends_with(before, token) AND length(before) > length(token) AND NOT known THEN 'echo' END AS label FROM r)
SELECT label, token, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL""",
}
