"""The registered queries of the training-data operators, one for each operator: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import hostrules, itemsets, kdmeans, langid, licenses, mixing, pii, rollups, secretscan, simhash, tokenbin, warc, winnowing


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("item_ids")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every document as it stands, by both word patterns and a tokenizer file. A tokenizer has no SQL: tested against plain Python."""
    import public_tokenizers

    docs, path = C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return rollups.count_all(docs, C.fresh_dir(spark, "rollup"), path, "byte_bpe_50k/1").totals()


def op2_word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by the word patterns after batches that delete short documents and revise the others, as its SQL has them."""
    return rollups.maintain(C.table(spark, sf_dir, "documents"), C.fresh_dir(spark, "rollup")).totals()


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(C.table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(C.table(spark, sf_dir, "pages"), C.fresh_dir(spark, "warc")).drop("bundle")


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(C.table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(C.table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(C.table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(C.table(spark, sf_dir, "documents")))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents")
    out = tokenbin.encode_table(docs, C.fresh_dir(spark, "token-ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_closed_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.report(itemsets.mine(C.table(spark, sf_dir, "sale_lines")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.find(C.table(spark, sf_dir, "documents")))


def op13_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.cluster(C.table(spark, sf_dir, "embeddings"))


def _kd_means_sql(rounds: int = kdmeans.ROUNDS) -> str:
    """Every vector against every centroid, a pair of tables for each round."""
    near = """a{n} AS MATERIALIZED (SELECT r, id, x, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (
  SELECT r, id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v, c{n} c) GROUP BY r, id, x)"""
    mean = """c{m} AS MATERIALIZED (SELECT c{n}.k, coalesce(m.x, c{n}.x) AS x FROM c{n} LEFT JOIN (SELECT k, list(f ORDER BY d) AS x FROM (
  SELECT k, d, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS d FROM a{n}) GROUP BY k, d) GROUP BY k) m USING (k))"""
    steps = [part for n in range(rounds) for part in (near.format(n=n), mean.format(n=n, m=n + 1))]
    steps.append(near.format(n=rounds))
    return """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda e: 1024 * e::DOUBLE) AS y FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(y, lambda e: floor(e)::BIGINT) AS x FROM w WHERE len(list_filter(y, lambda e: isfinite(e) AND abs(e) < 67108864)) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('3:' || coalesce(id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT 8)),
""" + ",\n".join(steps) + f"""
SELECT id AS vec_id, a.k::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_rollup, op3_simhash, op4_mix_sources, op5_warc_bundles, op6_host_rules, op7_licenses, op8_language, op9_personal_data, op10_token_binary, op2_word_rollup, op11_closed_itemsets, op12_secrets, op13_kd_means)}

ORACLE = {
    "op1_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT id, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS t FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM wins),
occ AS (SELECT rid, s, k, array_to_string(w[s : s + k - 1], ' ') AS t FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k)),
found AS (SELECT rid, s, occ.k AS k, id FROM occ JOIN wins ON occ.t = wins.t AND occ.k = wins.k),
hit AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT rid, s, k FROM found)) GROUP BY rid),
ids AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS list FROM (SELECT DISTINCT rid, id FROM found WHERE id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)""",
    "op5_warc_bundles": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM k""",
    "op6_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, s, array_to_string(w[s : s + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
r AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(range(s, s + 5)) AS p FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY rid),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (rid)),
e AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS lengths FROM f),
w AS (SELECT source, count(*)::DOUBLE AS n, sum(short::INT)::DOUBLE AS short, sum(repeats::INT)::DOUBLE AS repeats, sum(symbols::INT)::DOUBLE AS symbols, sum(lines::INT)::DOUBLE AS lines, sum(lengths::INT)::DOUBLE AS lengths FROM e GROUP BY source),
h AS (SELECT source, n, short AS k, 'short' AS rule FROM w UNION ALL SELECT source, n, repeats, 'repeats' FROM w UNION ALL SELECT source, n, symbols, 'symbols' FROM w UNION ALL SELECT source, n, lines, 'lines' FROM w UNION ALL SELECT source, n, lengths, 'lengths' FROM w),
s AS (SELECT rule, count(*)::DOUBLE AS m, sum(n) AS nn, sum(k) AS kk, sum(k * k / n) AS spread, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS told FROM h GROUP BY rule),
p AS (SELECT *, greatest(least(kk / nn, 0.999999), 0.000001)::DOUBLE AS mean FROM s),
q AS (SELECT rule, mean, greatest(least(CASE WHEN told > 1e-9 * nn THEN ((spread - kk * kk / nn) / (mean * (1 - mean)) - (m - 1)) / told ELSE 0 END, 0.5), 1.0::DOUBLE / 1001)::DOUBLE AS share FROM p),
u AS (SELECT rule, mean, 1 / share - 1 AS strength, least(0.6, greatest(0.3, mean + 2 * sqrt(mean * (1 - mean) * share))) AS lim FROM q),
v AS (SELECT source, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) > lim) AS host_rejected
  FROM (SELECT source, n, strength, lim, (k + mean * strength) / (n + strength) AS rate FROM h JOIN u USING (rule)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, host_rejected, NOT (short OR repeats) AND NOT host_rejected AS kept
FROM e JOIN v ON e.source IS NOT DISTINCT FROM v.source""",
    "op2_word_rollup": r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t, translate(coalesce(text, ''), '#*$%&|<>', '') AS c FROM documents),
n AS (SELECT source, lang, t, c FROM d WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 10),
r AS (SELECT source, lang, 'space-words/1' AS tokenizer, len(regexp_extract_all(c, '[^\x20\x09-\x0D]+')) AS k FROM n
  UNION ALL SELECT source, lang, 'plain-words/1', len(regexp_extract_all(c, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM n)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(k)::BIGINT AS tokens FROM r GROUP BY source, lang, tokenizer""",
    "op4_mix_sources": r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, coalesce(sum(size), 0)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
plan AS (SELECT source, source_size, CASE WHEN level > cap / weight THEN cap ELSE least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) END AS target FROM levels),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sizes JOIN plan ON sizes.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated""",
    "op11_closed_itemsets": r"""
WITH RECURSIVE b AS (SELECT DISTINCT sale_id AS s, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
t AS (SELECT count(DISTINCT s) AS n FROM b),
f AS (SELECT i, count(*) AS c FROM b GROUP BY i HAVING count(*) >= 8 AND count(*) * 5000 >= (SELECT n FROM t)),
h AS (SELECT b.s, b.i FROM b JOIN f USING (i)),
occ AS (SELECT [i] AS x, s FROM h
  UNION ALL SELECT x, s FROM (SELECT list_append(o.x, h.i) AS x, o.s, count(*) OVER (PARTITION BY o.x, h.i) AS c FROM occ o JOIN h ON o.s = h.s AND h.i > o.x[-1])
  WHERE c >= 8 AND c * 5000 >= (SELECT n FROM t)),
sets AS (SELECT x, count(*) AS c FROM occ GROUP BY x),
parts AS (SELECT x, c, d, list_filter(x, lambda e: e <> d) AS p FROM (SELECT x, c, unnest(x) AS d FROM sets WHERE len(x) > 1)),
open AS (SELECT DISTINCT sets.x FROM sets JOIN parts ON sets.x = parts.p AND sets.c = parts.c),
closed AS (SELECT x, c FROM sets WHERE x NOT IN (SELECT x FROM open)),
told AS (SELECT parts.x, parts.d, sets.c AS a, f.c AS s FROM parts JOIN closed USING (x) JOIN sets ON sets.x = parts.p JOIN f ON f.i = parts.d
  WHERE 100 * parts.c >= 10 * sets.c AND parts.c * (SELECT n FROM t) > sets.c * f.c),
per AS (SELECT x, count(*) AS k, arg_min(d, (a, d)) AS best, string_agg(d || ':' || a || ':' || s, ';' ORDER BY d) AS list FROM told GROUP BY x)
SELECT array_to_string(closed.x, ',') AS items, len(closed.x)::BIGINT AS n_items, c::BIGINT AS support, coalesce(k, 0)::BIGINT AS n_rules, best AS best_item, sha256(coalesce(list, '')) AS rules_sha256
FROM closed LEFT JOIN per ON closed.x = per.x""",
    "op13_kd_means": _kd_means_sql(),
}
