"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgate.llm import chat, divergence, exact, fmindex, katz, packing, quality, repair, secrets, simhash, suffixes, tiling, urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed value: the white space class of the contracts.
SPACE = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op3_exact_dedup",
    rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
""",
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=2)


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7
    )


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = packing.encoder(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    return packing.pack(table(spark, sf_dir, "documents"), make, packing.CAPACITY)


#: Fixed value: the extra conversation's text.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


@query(
    "op10_chat_formatting",
    rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{EXTRA_TEXT}'), (-1, 1, 'assistant', '{EXTRA_TEXT}')),
e AS (SELECT *, regexp_replace(text, '{chat.ESCAPE}', '\1\\\2\3', 'g') AS safe,
    regexp_replace(role, '{chat.ESCAPE}', '\1\\\2\3', 'g') AS safe_role, lag(role) OVER w AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN before = role THEN 3 ELSE 10 + length(safe_role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(-1).cast("long").alias("conv_id"),
                        F.lit(turn).cast("long").alias("turn"),
                        F.lit(role).alias("role"),
                        F.lit(EXTRA_TEXT).alias("text"),
                    )
                    for turn, role in enumerate(("user", "assistant"))
                ]
            )
        )
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


#: The contract's rules.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


@query(
    "op1_url_filters",
    rf"""
WITH u AS (SELECT DISTINCT coalesce(url, '') AS url FROM pages),
h AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '=[^&]*', '', 'g') AS keys FROM u),
t AS (SELECT url, host, path, list_sort(list_distinct(['h:' || x FOR x IN string_split(host, '.') IF x <> '']
    || ['p:' || x FOR x IN string_split(path, '/') IF x <> ''] || ['q:' || x FOR x IN string_split(keys, '&') IF x <> ''])) AS tokens FROM h),
rules(rh, rp, rule, rv) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
    ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
l AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv
  FROM t JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
d AS (SELECT t.*, rule, rv FROM t LEFT JOIN l USING (url)),
n AS (SELECT count(*) AS n FROM d WHERE rv IS NOT NULL),
s AS (SELECT rv, [tokens[i] FOR i IN range(1, len(tokens) + 1) IF (m >> (i - 1)::INT) % 2 = 1] AS needed
  FROM d, unnest(range(1, (1::BIGINT << len(tokens)::INT))) AS r(m) WHERE rv IS NOT NULL),
p AS (SELECT needed, count(*) FILTER (rv = 'block') AS b, count(*) AS c FROM s GROUP BY needed),
q AS (SELECT needed, b / c AS confidence, array_to_string(needed, ' ') AS pattern FROM p, n
  WHERE b >= ceil({urls.MIN_SUPPORT} * n) AND b / c >= {urls.MIN_CONFIDENCE}),
f AS (SELECT url, max(confidence) AS confidence FROM d JOIN q ON list_has_all(tokens, needed) GROUP BY url),
g AS (SELECT f.url, f.confidence, max(pattern) AS pattern FROM f JOIN d USING (url)
  JOIN q ON q.confidence = f.confidence AND list_has_all(tokens, needed) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  confidence, pattern
FROM pages JOIN d ON coalesce(pages.url, '') = d.url LEFT JOIN g ON g.url = d.url
""",
)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op4_substring_dedup",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + {fmindex.THRESHOLD - 1}], ' ') AS k
  FROM d, unnest(range(1, len(w) - {fmindex.THRESHOLD - 2})) AS t(i) WHERE len(w) >= {fmindex.THRESHOLD}),
c AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i FROM s JOIN c USING (k)),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT r, i, word, max(CASE WHEN m.r IS NOT NULL THEN i END) OVER (PARTITION BY r ORDER BY i) AS last
  FROM p LEFT JOIN m USING (r, i)),
g AS (SELECT r, i, word, last IS NOT NULL AND i - last < {fmindex.THRESHOLD} AS gone FROM f),
o AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept,
    count(*) FILTER (starts) AS spans
  FROM (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS starts FROM g) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (r)
""",
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.substring_dedup(table(spark, sf_dir, "documents"), fmindex.THRESHOLD)


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"), suffixes.THRESHOLD)


@query("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query(
    "op11_conversation_repair",
    rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
e AS (SELECT conv_id, turn, role, text, left(role, 1) AS g, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM e),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS v FROM f
  UNION ALL SELECT conv_id, i, q, min(v) FROM (
    SELECT m.conv_id, f.i, CASE e WHEN 'D' THEN p WHEN 'K' THEN CASE g WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE p WHEN 2 THEN 3 ELSE 2 END END AS q,
      {{'c': c + CASE e WHEN 'D' THEN 3 ELSE (CASE e WHEN 'R' THEN 2 ELSE 0 END) + (fault = 'truncated')::BIGINT END, 'a': a || e,
        'l': CASE e WHEN 'D' THEN l WHEN 'K' THEN l || [role || ':' || text] ELSE l || [CASE p WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END}} AS v
    FROM (SELECT s.conv_id, s.i, CASE WHEN k = 0 THEN q WHEN (q = 2) = (k = 1) THEN 3 ELSE 2 END AS p, v.c + 2 * k AS c, v.a || repeat('I', k::INT) AS a,
        v.l || list_transform(range(k), lambda j: CASE WHEN (q = 2) = (j = 0) THEN 'assistant:' ELSE 'user:' END) AS l
      FROM s, range(3) AS r(k)) AS m
    JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i + 1, (VALUES ('D'), ('K'), ('R')) AS x(e)
    WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR (g = 's' AND p = 0) OR (g = 'u' AND p <> 2) OR (g = 'a' AND p = 2)))
  ) GROUP BY conv_id, i, q),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || g NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
o AS (SELECT n.conv_id, min({{'c': v.c + 2 * k, 'a': v.a || repeat('I', k::INT), 'l': v.l || list_transform(range(k), lambda j:
      CASE WHEN (q = 2) = (j = 0) THEN 'assistant:' ELSE 'user:' END)}}) AS v
  FROM n JOIN s ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.n, range(3) AS r(k)
  WHERE CASE WHEN k = 0 THEN q IN (0, 3) ELSE (q = 2) = (k = 1) END GROUP BY n.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit,
  sha256(coalesce(array_to_string(v.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id
""",
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair_report(rows, repair.damage(rows))


@query(
    "op12_source_divergence",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (n.n + 5 * v.v) AS p,
    1 + (1000000000 * (k.total + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term
  WHERE a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 50
""",
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@query("op13_lm_scoring")
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("doc_id").cast("string").cast("binary")
    return katz.katz(table(spark, sf_dir, "documents"), F.crc32(name) % 10 == 0).scores
