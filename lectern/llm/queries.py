"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import lm_scores
from .decontaminate import WINDOW, contamination
from .licenses import GAP, LEAST, license_rows, template_rows
from .line_runs import MIN_WORDS, line_report
from .mixing import EPOCHS, LANG_WEIGHTS, OTHER_LANG, SEED, SHARE_PERCENT, mixture
from .ngram_join import ngram_components
from .quality import LIFT, SIGNS, quality_verdicts
from .secrets import secret_spans
from .shards import TABLE, assign_shards, lookup_table, shard_names
from .url_filter import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_table(spark, sf_dir, "documents"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rows(_table(spark, sf_dir, "documents")).drop("spans")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return per.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))).select("doc_id", "n_chars", "slot", "shard")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = line_report(_table(spark, sf_dir, "documents"))
    return per.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents")).drop("tx")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scans, op3_license_scans, op4_benchmark_decontamination, op5_url_filters, op6_sharding, op7_line_dedup, op8_source_mixing, op9_quality_rules, op10_lm_scoring)}


_WORDS = r"regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter({_WORDS.format(x="coalesce(text, '')")}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter({_WORDS.format(x="coalesce(text, '')")}, lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), {WINDOW}) AS m, w[i:i + least(len(w), {WINDOW}) - 1] AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, w[i:i + m - 1] AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = f"""
WITH p AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {TABLE} AS BIGINT) AS slot FROM documents)
SELECT doc_id, n_chars, slot, CAST(([{", ".join(map(str, lookup_table(shard_names())))}])[slot + 1] AS BIGINT) AS shard FROM p
"""

_TOKENS = r"len(list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

OP7_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, i - 1 AS line, ls[i] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
k AS (SELECT doc_id, line, x, {_TOKENS.format(x="x")} AS w FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM k WHERE w > 0),
m AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.pos AS a_pos, b.pos AS b_pos, b.line, b.w FROM p a JOIN p b ON a.x = b.x AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.pos < b.pos)),
i AS (SELECT *, a_pos - row_number() OVER (PARTITION BY a_id, b_id, b_pos - a_pos ORDER BY a_pos) AS run FROM m),
t AS (SELECT b_id, line, sum(w) OVER (PARTITION BY a_id, b_id, b_pos - a_pos, run) AS words FROM i),
g AS (SELECT DISTINCT b_id AS doc_id, line FROM t WHERE words >= {MIN_WORDS}),
l AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM s LEFT JOIN l USING (doc_id)
"""


def _fill(level: str, above: list[str], weight: str, name: str, parents: str, epochs: int) -> str:
    """SQL of one level of the budgets: children of each family by capacity for weight, filled as in mixing.leaf_budgets."""
    here = [*above, level]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    join = " AND ".join(f"k.{c} IS NOT DISTINCT FROM q.{c}" for c in above) or "true"
    return f"""
{name}_k AS (SELECT {", ".join(here)}, sum(tokens * {epochs}) AS cap, {weight} AS w FROM leaves GROUP BY {", ".join(here)}),
{name}_s AS (SELECT k.*, q.budget, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_b,
  coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_b, sum(w) OVER ({part.replace("BY ", "BY k.").replace(", ", ", k.")}) AS w_all
  FROM {name}_k k JOIN {parents} q ON {join} WINDOW o AS ({("PARTITION BY " + ", ".join("k." + c for c in above)) if above else ""} ORDER BY cap / w, k.{level})),
{name}_f AS (SELECT *, (budget - cap_b) / (w_all - w_b) AS rate, cap <= (budget - cap_b) / (w_all - w_b) * w AS is_full FROM {name}_s),
{name}_l AS (SELECT *, max(CASE WHEN NOT is_full THEN rate END) OVER ({part}) AS r FROM {name}_f),
{name} AS (SELECT {", ".join(here)}, CAST(CASE WHEN is_full THEN cap ELSE least(cap, floor(r * w)) END AS BIGINT) AS budget FROM {name}_l)"""


_LANG = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + f" ELSE {OTHER_LANG} END"
def mixture_sql(epochs: int) -> str:
    """SQL of mixing.mixture."""
    return rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(regexp_extract(source, '^([A-Za-z]*)', 1), '') AS domain,
  CAST({_TOKENS.format(x="coalesce(text, '')")} AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
root AS (SELECT CAST(floor(sum(tokens) * {SHARE_PERCENT} / 100) AS BIGINT) AS budget FROM leaves),
{_fill("domain", [], "1", "b1", "root", epochs)},
{_fill("lang", ["domain"], _LANG, "b2", "b1", epochs)},
{_fill("source", ["domain", "lang"], "1", "b3", "b2", epochs)},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM leaves l JOIN b3 USING (domain, lang, source)),
run AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM docs d JOIN plan USING (domain, lang, source))
SELECT doc_id, lang, source, n_tokens, CAST(whole AS BIGINT) AS epoch FROM run WHERE upto <= rest
UNION ALL SELECT doc_id, lang, source, n_tokens, CAST(e AS BIGINT) AS epoch FROM (SELECT *, unnest(range(0, CAST(whole AS BIGINT))) AS e FROM run)
"""


OP8_SQL = mixture_sql(EPOCHS)

OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + least(len(w), 5) - 1] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
d AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id, CAST(coalesce(d.k, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON doc_id = m.a LEFT JOIN d ON doc_id = d.a
"""


def _template_rows() -> str:
    """(tid, label, base, size, t, gram) of all templates' grams, as SQL values."""
    return ", ".join(f"('{tid}', '{label}', {base}, {size}, {t}, [{', '.join(repr(x) for x in gram)}])" for tid, label, base, size, t, gram in template_rows())


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter({_WORDS.format(x="coalesce(text, '')")}, lambda x: x <> '') AS w FROM documents),
t(tid, label, base, size, t, gram) AS (VALUES {_template_rows()}),
g AS (SELECT doc_id, i - 1 AS p, w[i:i + k - 1] AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (4)) ks(k) WHERE len(w) >= k)),
v AS (SELECT doc_id, tid, label, base, size, p - t AS diagonal, p AS s, p + len(gram) AS e FROM g JOIN t USING (gram)),
o AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER x > {GAP} OR lag(diagonal) OVER x IS NULL THEN 1 ELSE 0 END AS apart
  FROM (SELECT DISTINCT doc_id, tid, base, diagonal FROM v) WINDOW x AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
r AS (SELECT doc_id, tid, diagonal, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS run FROM o),
c AS (SELECT doc_id, tid, run, label, base, size, min(s) AS s, count(DISTINCT q) AS n
  FROM (SELECT doc_id, tid, run, label, base, size, s, unnest(range(s, e)) AS q FROM v JOIN r USING (doc_id, tid, diagonal)) GROUP BY doc_id, tid, run, label, base, size),
f AS (SELECT doc_id, label, base, s, least(1.0, CAST(n AS DOUBLE) / size) AS score FROM c),
h AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM f WHERE base OR score >= {LEAST} GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN h USING (doc_id)
"""


def _host_rule(r: str) -> str:
    """SQL of one rule's verdict on a host, as in quality.host_verdicts."""
    v = f"(q_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * chance)"
    s = f"greatest(1.0, m_{r} * (1 - m_{r}) / {v} - 1)"
    return f"CASE WHEN {v} > 0 THEN (f_{r} + m_{r} * {s}) / (n + {s}) >= {LIFT} * m_{r} ELSE false END AS bad_{r}"


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ 	-
]') GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{e} AS sign_{r}" for r, e in SIGNS.items())} FROM m),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (sign_{r}) AS f_{r}" for r in SIGNS)} FROM s GROUP BY source),
p AS (SELECT avg(1 / n) AS chance, {", ".join(f"avg(f_{r} / n) AS m_{r}, avg((f_{r} / n) * (f_{r} / n)) AS q_{r}" for r in SIGNS)} FROM h),
b AS (SELECT source, {", ".join(map(_host_rule, SIGNS))} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"(sign_{r} AND bad_{r})" for r in SIGNS)}) AS kept
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source
"""


def _over(sql: str, table: str) -> str:
    """sql over another table of documents."""
    return sql.replace("FROM documents", f"FROM {table}")


#: The five stages of the pipeline, each over what the one before it kept.
PIPELINE_SQL = f"""
WITH good AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({OP9_SQL}) WHERE kept)),
one AS MATERIALIZED (SELECT * FROM good WHERE doc_id IN (SELECT doc_id FROM ({_over(OP1_SQL, "good")}) WHERE component_id = doc_id)),
clean AS MATERIALIZED (SELECT * FROM one WHERE doc_id NOT IN (SELECT doc_id FROM ({_over(OP4_SQL, "one")}) WHERE contaminated)),
mixed AS MATERIALIZED (SELECT * FROM clean WHERE doc_id IN (SELECT doc_id FROM ({_over(mixture_sql(1), "clean")}))),
placed AS ({_over(OP6_SQL, "mixed")})
SELECT mixed.*, slot, shard FROM mixed JOIN placed USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op3_license_scans": OP3_SQL, "op9_quality_rules": OP9_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_sharding": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_source_mixing": OP8_SQL}
