"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, minhash, mixing, packing, pii, quality, secret_scan, tokens, toxicity, url_filter

from .scratch import new_path
from .spans import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.refine(_table(spark, sf_dir, "documents"), hash_unique=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(_table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=(85, 100))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.array(*[F.lit(k) for k in (*pii.BASE, *pii.EXTRA)])
    place = lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    everything = F.array_sort(F.concat(F.transform("base", place), F.transform("added", place)))
    return out.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(everything).alias("spans"), F.size(everything).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = new_path(spark, "ledger")
    index = secret_scan.update(_table(spark, sf_dir, "documents"), ledger, "doc_id", "text")
    out = secret_scan.report(index, ledger)
    order = F.array(*[F.lit(r.name) for r in secret_scan.RULES])
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("rank"), s["end"].alias("end"), s["rule"].alias("kind"))
    out = out.withColumn("everything", F.array_sort(F.transform("findings", place)))
    base = F.filter("everything", lambda s: s["rank"] <= len(secret_scan.BASE))
    count = lambda kind: F.size(F.filter("everything", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("path").alias("doc_id"), *[count(k) for k in secret_scan.BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("everything")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (VALUES (3), (8), (61)) AS v(k))),
h AS (SELECT doc_id, k, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k, s) > 1),
c AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id, k),
l AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS dups
  FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dups, 0)::BIGINT AS n_dup_lines,
         coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c8.n, 0)::BIGINT AS n_covered, coalesce(c61.n, 0) > 0 AS too_long
  FROM d LEFT JOIN l USING (doc_id)
  LEFT JOIN c c3 ON c3.doc_id = d.doc_id AND c3.k = 3
  LEFT JOIN c c8 ON c8.doc_id = d.doc_id AND c8.k = 8
  LEFT JOIN c c61 ON c61.doc_id = d.doc_id AND c61.k = 61)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= 0.3 * n_words AND NOT too_long AS kept
FROM m
"""

_LABELS = ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)
_RULE = "CASE " + " ".join(
    f"WHEN (host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}')) AND starts_with(path, '{rule[rule.index('/'):]}') THEN '{rule}'" for _, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1]))
) + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in url_filter.RULES) + " ELSE CASE WHEN host <> '' AND lower_ > greatest(0.3, upper_) THEN 'block' ELSE 'allow' END END"


def _level_sql(name: str, children: str, parent: str, above: str, few: int = 1) -> str:
    """Posterior mean and pull of each ``parent`` group over ``children``; ``above`` has up_mean and up_pull."""
    return f"""
{name}0 AS (SELECT c.{parent}, any_value(up_mean) AS um, any_value(up_pull) AS up, sum(bad) AS b, sum(n) AS k, sum(CASE WHEN n > 0 THEN bad * bad / n ELSE 0 END) AS bb, sum((n > 0)::INT) AS c
  FROM {children} c JOIN {above} a ON a.{parent} = c.{parent} GROUP BY c.{parent}),
{name}1 AS (SELECT *, (b + um * up) / (k + up) AS mean FROM {name}0),
{name}2 AS (SELECT *, mean * (1 - mean) AS q, bb - 2 * mean * b + mean * mean * k - c * (mean * (1 - mean)) AS spread FROM {name}1),
{name} AS (SELECT {parent}, CASE WHEN c <= {few} THEN um ELSE mean END AS mean, CASE WHEN c <= {few} THEN up WHEN k > 0 AND spread > 0 THEN least(50.0, greatest(2.0, q * k / spread - 1)) ELSE 50.0 END AS pull FROM {name}2)"""


OP5_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(html, ''), '(?s)<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>', ' ', 'g') AS seen FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path,
             len(regexp_extract_all(seen, '\S+')) AS words, len(regexp_extract_all(seen, '[#*$%|!]{{2,}}|(?:&amp;){{2,}}')) AS marked FROM u),
r AS (SELECT *, (words < 20 OR marked > 0.3 * words OR regexp_matches(host || lower(path), '{url_filter.bad_words_pattern()}'))::INT AS bad FROM p),
h0 AS (SELECT host, sum(bad)::DOUBLE AS bad, count(bad)::DOUBLE AS n, regexp_replace(host, ':[0-9]*$', '') AS name FROM r GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS ls FROM h0),
h2 AS (SELECT *, len(ls) AS m, CASE WHEN len(ls) >= 3 AND ls[-2] IN ({_LABELS}) AND length(ls[-1]) = 2 THEN 3 ELSE 2 END AS keep FROM h1),
h AS (SELECT host, bad, n, array_to_string(ls[m - keep + 2:m], '.') AS suffix, 1 AS every,
             CASE WHEN m <= keep OR regexp_full_match(name, '[0-9.]+') OR contains(name, '[') THEN name ELSE array_to_string(ls[m - keep + 1:m], '.') END AS domain FROM h2),
d AS (SELECT domain, suffix, 1 AS every, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, 1 AS every, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
flat AS (SELECT 1 AS every, 0.5::DOUBLE AS up_mean, 2.0::DOUBLE AS up_pull),{_level_sql("root", "s", "every", "flat", 0)},{_level_sql("corpus", "h", "every", "flat", 0)},
ups AS (SELECT suffix, mean AS up_mean, pull AS up_pull FROM s, root),{_level_sql("sx", "d", "suffix", "ups")},
upd AS (SELECT domain, sx.mean AS up_mean, sx.pull AS up_pull FROM d JOIN sx ON sx.suffix = d.suffix),{_level_sql("dm", "h", "domain", "upd")},
cp AS (SELECT least(1.0, mean + 1.645 * sqrt(mean * (1 - mean) / (pull + 1))) AS upper_ FROM corpus),
ab AS (SELECT host, bad + mean * pull AS a, n - bad + (1 - mean) * pull AS b FROM h JOIN dm ON dm.domain = h.domain),
rep AS (SELECT host, greatest(0, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS lower_, upper_ FROM ab, cp),
j AS (SELECT page_id, host, path, {_RULE} AS rule FROM r)
SELECT page_id, j.host, path, rule, {_VERDICT.replace('host', 'j.host')} AS verdict FROM j LEFT JOIN rep ON rep.host = j.host
"""

OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w,
              source_size::HUGEINT * 3 AS cap, (sum(source_size) OVER ())::HUGEINT AS total FROM s0),
s2 AS (SELECT *, total - sum(cap) OVER o + cap AS left_, sum(w) OVER () - sum(w) OVER o + w AS open_w FROM s1
       WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, cap * open_w <= left_ * w AS filled FROM s2),
s4 AS (SELECT source, source_size, total::BIGINT AS total,
              CASE WHEN filled THEN cap::DOUBLE ELSE
                (total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN filled THEN 0 ELSE w END) OVER ())::DOUBLE * w::DOUBLE END AS target
       FROM s3),
p AS (SELECT *, floor(total::DOUBLE / 32 + 0.5)::BIGINT AS t, count(*) OVER () AS s, sum(target) OVER () AS v FROM s4),
p1 AS (SELECT *, CASE WHEN t > s AND v > 0 THEN floor(target * (t - s) / v + 0.5)::BIGINT ELSE 0 END AS lo,
              CASE WHEN v > 0 THEN floor(target * (t + s) / v + 0.5)::BIGINT ELSE 0 END AS hi FROM p),
p2a AS (SELECT *, t - sum(lo) OVER () AS rest FROM p1),
p2 AS (SELECT *, unnest(range(lo, hi + 1)) AS k FROM p2a),
p3 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source ASC NULLS LAST, k) AS rank FROM p2),
src AS (SELECT source, source_size, target, greatest(1, ceil(source_size / greatest(250000.0, total / 10000)))::BIGINT AS n_shards,
               lo + sum(CASE WHEN rank <= rest AND v > 0 THEN 1 ELSE 0 END) AS quota FROM p3 GROUP BY source, source_size, target, total, lo),
d AS (SELECT r.*, source_size, target, quota AS source_quota, ('0x' || draw[1:8])::BIGINT % n_shards AS shard
      FROM r JOIN src ON r.source IS NOT DISTINCT FROM src.source),
h AS (SELECT source, shard, source_quota AS t, sum(size)::BIGINT AS shard_size FROM d GROUP BY ALL),
h1 AS (SELECT *, count(*) OVER g AS s, sum(shard_size::DOUBLE) OVER g AS v FROM h WINDOW g AS (PARTITION BY source)),
h2 AS (SELECT *, CASE WHEN t > s AND v > 0 THEN floor(shard_size::DOUBLE * (t - s) / v + 0.5)::BIGINT ELSE 0 END AS lo,
              CASE WHEN v > 0 THEN floor(shard_size::DOUBLE * (t + s) / v + 0.5)::BIGINT ELSE 0 END AS hi FROM h1),
h3 AS (SELECT *, t - sum(lo) OVER (PARTITION BY source) AS rest FROM h2),
h4 AS (SELECT *, unnest(range(lo, hi + 1)) AS k FROM h3),
h5 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS rank FROM h4),
q AS (SELECT source, shard, shard_size, lo + sum(CASE WHEN rank <= rest AND v > 0 THEN 1 ELSE 0 END) AS quota FROM h5 GROUP BY source, shard, shard_size, lo),
f AS (SELECT d.*, shard_size, sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begins,
             least(quota * 32, shard_size * 3) AS words
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard),
f1 AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds FROM f)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, words - rounds * shard_size - begins)))::BIGINT AS taken
FROM f1
"""

QUERIES = {"op10_toxicity": op10_toxicity, "op4_pii_boosting": op4_pii_boosting, "op7_secret_ledger": op7_secret_ledger, "op1_minhash_dedup": op1_minhash_dedup, "op3_repetition_rules": op3_repetition_rules, "op6_pack_sequences": op6_pack_sequences, "op2_token_files": op2_token_files, "op8_exact_dedup": op8_exact_dedup, "op9_source_mix": op9_source_mix, "op5_url_filter": op5_url_filter}
ORACLES = {"op1_minhash_dedup": OP1_SQL, "op5_url_filter": OP5_SQL, "op3_repetition_rules": OP3_SQL, "op8_exact_dedup": OP8_SQL, "op9_source_mix": OP9_SQL}
