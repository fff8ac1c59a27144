"""Registered queries of the text operators: key → (Spark callable, SQL text or None).

Each applies its operator, with production parameters, to the whole of its tables and derives digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, exact_dedup, html_text, line_dedup, minhash_forest, periodic_runs, prefix_trie, quality, simhash,
               substring_dedup, toxicity, url_filters)
from .common import read, texts


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hashed = texts(docs).select("doc_id", F.lower(F.hex(exact_dedup.full_hash("text"))).alias("text_sha256"))
    return exact_dedup.marked(hashed, exact_dedup.verdicts(docs), "text_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept
FROM d WINDOW w AS (PARTITION BY t)
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to_word"] - s["from_word"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        _sha(F.concat_ws(",", F.array_sort("items"))).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = quality.score(docs, quality.fit(docs, quality.may_learn(labels)))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score",
                        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM d),
toks AS (SELECT doc_id, no, list_transform(
           list_filter(regexp_split_to_array(line, '[\x09\x0B\x0C\x0D\x20]+'), lambda t: t <> ''),
           lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM lines),
keyed AS (SELECT *, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM toks WHERE len(tokens) >= 4),
near AS (SELECT * FROM keyed WHERE leaf IN (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5)),
seen AS (SELECT leaf, pos, token, count(*) AS n
         FROM (SELECT leaf, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM near) GROUP BY ALL),
places AS (SELECT leaf, pos, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(token, n) ELSE '<*>' END AS token FROM seen GROUP BY leaf, pos),
tmpl AS (SELECT leaf, list(token ORDER BY pos) AS template FROM places GROUP BY leaf),
members AS (SELECT doc_id, no, leaf FROM near JOIN tmpl USING (leaf)
            WHERE len(list_filter(list_zip(tokens, template), lambda p: p[1] = p[2])) >= 0.6 * len(tokens)),
dropped AS (SELECT doc_id, no FROM members
            WHERE leaf IN (SELECT leaf FROM members GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5))
SELECT doc_id, count(*) AS n_lines, count(x.no) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (WHERE x.no IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN dropped x USING (doc_id, no) GROUP BY doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.char_model(docs)
    found = toxicity.score(docs, model, toxicity.fit(docs, labels.where(~toxicity.held_out()), model))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch days of the pages, and dated entries of three lists for hosts, domains and paths that occur.

    The tables have no dates, so they follow from page_id; entries are added, removed and added again.
    """
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 730 as int))").alias("fetched"))
    parts = url_filters.path_parts(F.col("url"))
    named = captures.select("page_id", url_filters.host(F.col("url")).alias("host"), F.get(parts, F.lit(0)).alias("part")).where("host <> ''")
    values = (named.select("page_id", F.expr("stack(3, 'host', host, 'domain', regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1), "
                                             "'path', host || '/' || part) as (kind, value)"))
              .where("value <> ''").groupBy("kind", "value").agg(F.min("page_id").alias("k")))
    picked = values.where("kind = 'host' and k % 3 = 0 or kind = 'domain' and k % 5 = 0 or kind = 'path' and k % 7 = 0")
    dated = picked.select(F.expr("case k % 3 when 0 then 'malware' when 1 then 'adult' else 'spam' end as list"), "kind", "value", "k",
                          F.expr("explode(array(named_struct('action', 'add', 'after', 0, 'every', 1), "
                                 "named_struct('action', 'remove', 'after', 150, 'every', 2), named_struct('action', 'add', 'after', 300, 'every', 4))) as e"))
    return captures, dated.where("k % e.every = 0").select(
        "list", "kind", "value", "e.action", F.expr("date_add(date'2024-01-01', cast(k % 400 as int) + e.after)").alias("day"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filters.evaluate(*captures_and_entries(read(spark, sf_dir, "pages")))
    lists = F.array_join(F.array_sort(F.array_distinct(F.col("matches.list"))), ",")
    return found.select("page_id", "url", "fetched", "blocked", F.size("matches").cast("long").alias("n_matches"),
                        lists.alias("lists"), F.array_min(F.col("matches.since")).alias("since"))


OP8_SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched,
             rtrim(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)', 1)), '.') AS host,
             list_filter(string_split(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
           FROM (SELECT *, regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS bare FROM pages)),
named AS (SELECT page_id, 'host' AS kind, host AS value FROM c WHERE host <> ''
          UNION ALL SELECT page_id, 'domain', regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) FROM c WHERE host <> ''
          UNION ALL SELECT page_id, 'path', host || '/' || parts[1] FROM c WHERE host <> '' AND len(parts) > 0),
picked AS (SELECT kind, value, min(page_id) AS k FROM named WHERE value <> '' GROUP BY ALL
           HAVING kind = 'host' AND k % 3 = 0 OR kind = 'domain' AND k % 5 = 0 OR kind = 'path' AND k % 7 = 0),
entries AS (SELECT CASE k % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'adult' ELSE 'spam' END AS list, kind, lower(value) AS value, action,
              DATE '2024-01-01' + CAST(k % 400 + after AS INTEGER) AS day
            FROM picked, (VALUES ('add', 0, 1), ('remove', 150, 2), ('add', 300, 4)) e(action, after, every) WHERE k % every = 0),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM entries),
keys AS (SELECT DISTINCT url, fetched, 'host' AS kind, host AS value FROM c
         UNION ALL SELECT DISTINCT url, fetched, 'domain', array_to_string(string_split(host, '.')[i :], '.')
           FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c)
         UNION ALL SELECT DISTINCT url, fetched, 'path', lower(host || '/' || array_to_string(parts[1 : i], '/'))
           FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)),
hits AS (SELECT url, fetched, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, min(day) AS since
         FROM keys JOIN spans USING (kind, value)
         WHERE action = 'add' AND fetched >= day AND (until IS NULL OR fetched < until) GROUP BY url, fetched)
SELECT c.page_id, c.url, c.fetched, h.n IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_matches, coalesce(h.lists, '') AS lists, h.since
FROM c LEFT JOIN hits h USING (url, fetched)
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removed(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
wins AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win FROM starts),
later AS (SELECT doc_id, s FROM wins QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
gone_of AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN gone_of g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the tail of about a tenth of the texts repeats its first words, as the contract fixes it."""
    blank = r"'[\\x20\\x09-\\x0D]+'"
    return (texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
            .withColumn("words", F.expr(f"if(h % 10 = 0, filter(split(text, {blank}), w -> w <> ''), array())"))
            .selectExpr("doc_id", "text", "words", "cast(size(words) as bigint) as n", "h div 10 as g")
            .selectExpr("*", "if(n > 0, g % n, 0) as a").selectExpr("*", "1 + (n - a) div (3 + g % 8) as p")
            .selectExpr("doc_id", "if(n > 0, array_join(transform(words, (w, i) -> if(i >= a, words[cast(a + (i - a) % p as int)], w)), ' '), text) as text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed(looped(read(spark, sf_dir, "documents"))).withColumn("best", periodic_runs.longest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        _sha(F.array_join(listed, "")).alias("runs_sha256"), _sha(F.col("text")).alias("collapsed_sha256"))


CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce([xor(s, b)] || [3988292384, 3988292384, 3988292384, 3988292384, 3988292384, 3988292384, 3988292384, 3988292384],
    lambda x, poly: xor(x >> 1, (x & 1) * poly))), 4294967295)"""

#: Every pair of equal 16-grams at most a third of a document apart; neighbouring pairs at one lag are a stretch.
OP11_SQL = rf"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
              {CRC32_SQL.format("doc_id::VARCHAR")} AS h FROM documents WHERE doc_id IS NOT NULL),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + (CASE WHEN i >= a THEN a + (i - a) % p ELSE i END)]) ELSE w END AS w FROM d3),
grams AS (SELECT doc_id, n, s, hash(w[s + 1 : s + 16]) AS k, array_to_string(w[s + 1 : s + 16], ' ') AS gram
          FROM (SELECT *, unnest(range(n - 15)) AS s FROM d WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.s, y.s - x.s AS q FROM grams x JOIN grams y USING (doc_id, k, gram) WHERE y.s > x.s AND 3 * (y.s - x.s) <= x.n),
isl AS (SELECT doc_id, q, s, s - row_number() OVER (PARTITION BY doc_id, q ORDER BY s) AS island FROM pairs),
stretch AS (SELECT doc_id, q, min(s) AS start, max(s) + 16 - min(s) + q AS length FROM isl GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 20) / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best b USING (doc_id) LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.classes(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM d),
reps AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT rep, n, unnest(s) AS g FROM reps),
near AS (SELECT x.rep AS a, y.rep AS b FROM grams x JOIN grams y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
         GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM sets LEFT JOIN reps ON sets.s = reps.s LEFT JOIN comp USING (rep)
"""


def rebuilt(seqs: DataFrame) -> DataFrame:
    """(conv_id, turns) where a conversation begins with the first turns of one of its twenty, as the contract fixes it."""
    heads = seqs.where("conv_id % 20 = 0").selectExpr("conv_id as of", "slice(turns, 1, 3) as head")
    own = seqs.selectExpr("*", "conv_id - conv_id % 20 as base", "cast(crc32(cast(cast(conv_id as string) as binary)) % 4 as int) as h")
    return own.join(heads, F.col("base") == F.col("of"), "left").selectExpr(
        "conv_id", "concat(slice(coalesce(head, array()), 1, h), slice(turns, h + 1, size(turns))) as turns")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(rebuilt(prefix_trie.sequences(read(spark, sf_dir, "conversations"))))


OP13_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, upper(md5(octet_length(encode(r)) || ' ' || r || x))) AS i, r, x
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {CRC32_SQL.format("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
b0 AS (SELECT c.conv_id, t.i AS o, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h
       UNION ALL SELECT c.conv_id, 1000000 + t.i, t.r, t.x FROM c JOIN t USING (conv_id) WHERE t.i > c.h),
b AS (SELECT conv_id, row_number() OVER w AS d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
        string_agg(md5(octet_length(encode(r)) || ' ' || r || x), '') OVER w AS k FROM b0 WINDOW w AS (PARTITION BY conv_id ORDER BY o)),
m AS (SELECT conv_id, d, words, k FROM b UNION ALL SELECT conv_id, 0, 0, '' FROM c),
size AS (SELECT conv_id, max(d) AS n FROM m GROUP BY conv_id),
nodes AS (SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
            string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n) AS ends FROM m JOIN size USING (conv_id) GROUP BY k),
up AS (SELECT k, left(k, greatest(length(k) - 32, 0)) AS pk FROM nodes WHERE depth > 0),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk),
inside AS (SELECT DISTINCT x.k AS k, y.k AS u FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.d >= x.d),
total AS (SELECT i.k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens
          FROM inside i JOIN nodes u ON u.k = i.u LEFT JOIN kids ON kids.k = i.u GROUP BY i.k)
SELECT nodes.conv_id, nodes.depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN total USING (k) LEFT JOIN kids USING (k) LEFT JOIN up USING (k) LEFT JOIN nodes p ON p.k = up.pk
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_simhash_near_dedup": (op1_simhash_near_dedup, None),
    "op2_bpe_encode_decode": (op2_bpe_encode_decode, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_benchmark_decontamination": (op4_benchmark_decontamination, None),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_line_dedup": (op6_line_dedup, OP6_SQL),
    "op7_toxicity": (op7_toxicity, None),
    "op8_url_filters": (op8_url_filters, OP8_SQL),
    "op9_html_extraction": (op9_html_extraction, None),
    "op10_substring_dedup": (op10_substring_dedup, OP10_SQL),
    "op11_periodic_runs": (op11_periodic_runs, OP11_SQL),
    "op12_minhash_near_dedup": (op12_minhash_near_dedup, OP12_SQL),
    "op13_conversation_trie": (op13_conversation_trie, OP13_SQL),
}
