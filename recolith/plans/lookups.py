"""Registered queries of pattern lookups, group metrics, frequencies, best matches and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolith.operators import aggregates, dedup, matching, taxonomy
from recolith.plans.catalog import query, t
from recolith.sources import tables


@query(r"""
WITH q AS (SELECT DISTINCT lower(w) AS q FROM (SELECT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS w FROM benchmark) WHERE length(w) >= 3),
n AS (SELECT page_id, lower(url) AS n FROM pages)
SELECT page_id FROM n WHERE EXISTS (SELECT 1 FROM q WHERE contains(n.n, q.q))""")
def names_with_patterns(spark, d):
    """PF18: addresses that contain any word of the benchmark."""
    words = F.explode(F.split("text", "[^a-zA-Z]+"))
    patterns = t(spark, d, "benchmark").select(words.alias("q")).where(F.length("q") >= 3)
    return taxonomy.containing(t(spark, d, "pages"), "url", patterns, "q").select("page_id")


@query("""
WITH m AS (SELECT doc_id, lang AS g, n_chars FROM documents WHERE lang IS NOT NULL),
p AS (SELECT a.g, abs(a.n_chars - b.n_chars) AS gap, least(a.n_chars, b.n_chars) AS ov FROM m a JOIN m b ON a.g = b.g AND b.doc_id = a.doc_id + 1),
x AS (SELECT g, count(*) AS n_pairs, min(1.0::DOUBLE / (1 + gap)) AS lo, max(1.0::DOUBLE / (1 + gap)) AS hi, max(ov) AS ov FROM p GROUP BY g)
SELECT m.g, count(*) AS n_members, coalesce(any_value(n_pairs), 0) AS n_pairs, coalesce(any_value(lo), 1.0::DOUBLE) AS min_similarity, coalesce(any_value(hi), 1.0::DOUBLE) AS max_similarity, coalesce(any_value(ov), 0) AS max_overlap FROM m LEFT JOIN x ON x.g = m.g GROUP BY m.g""")
def group_metrics_rows(spark, d):
    """AG06: members, neighbouring pairs and the range of their likeness by language."""
    m = t(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("g"), "n_chars")
    after = m.select("g", (F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("other"))
    pairs = m.join(after, ["g", "doc_id"]).select("g", (F.lit(1.0) / (1 + F.abs(F.col("n_chars") - F.col("other")))).alias("similarity"), F.least("n_chars", "other").alias("overlap"))
    return dedup.group_metrics(m, pairs, "g")


@query("""
SELECT * FROM (SELECT coalesce(role, '') AS key, count(*) AS n FROM conversations WHERE length(text) > 20 GROUP BY 1 ORDER BY n DESC, key LIMIT 20)
UNION ALL SELECT * FROM (SELECT coalesce(w, '') AS key, count(*) AS n FROM (SELECT regexp_extract(text, '^[^ ]*') AS w FROM documents) GROUP BY 1 ORDER BY n DESC, key LIMIT 20)""")
def frequency_report(spark, d):
    """AG07, AG15, SL04: filtered frequencies of roles, and the 20 most frequent first words."""
    roles = aggregates.top_counts(t(spark, d, "conversations").where("length(text) > 20"), F.col("role"))
    words = aggregates.top_counts(t(spark, d, "documents"), F.regexp_extract("text", "^[^ ]*", 0))
    return roles.unionByName(words)


@query("""
WITH s AS (SELECT d.doc_id, l.doc_id AS other, 100 - abs(d.n_chars - l.n) AS score FROM documents d JOIN (SELECT x.doc_id, x.n_chars AS n, x.lang, x.n_chars // 40 AS b FROM documents x JOIN labels ON labels.doc_id = x.doc_id) l ON l.lang = d.lang AND l.b = d.n_chars // 40 AND l.doc_id <> d.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS r FROM s WHERE score > 0)
SELECT doc_id, other, score FROM k WHERE r = 1""")
def best_scored(spark, d):
    """WN05: each document's labelled document of its language that is nearest in length, ties to the smaller id.

    Lengths repeat, so the candidates of a length are its smallest two ids:
    one is the document itself at most.
    """
    docs = t(spark, d, "documents").where("lang IS NOT NULL")
    cut_ = F.floor(F.col("n_chars") / 40)
    near = docs.join(t(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("other"), F.col("n_chars").alias("n"), "lang", cut_.alias("b"))
    near = dedup.top_of_group(near, ["lang", "b", "n"], [F.asc("other")], 2).drop("rank")
    pairs = docs.select("doc_id", "n_chars", "lang", cut_.alias("b")).join(near, ["lang", "b"]).where("doc_id <> other")
    return matching.best_match(pairs.select("doc_id", "other", (100 - F.abs(F.col("n_chars") - F.col("n"))).alias("score")), "doc_id", "score", "other")


@query("""
WITH w AS (SELECT conv_id, unnest(['turn-' || max(turn) || '-x', 'user', 'turn-' || max(turn)]) AS name, unnest([0, 1, 2]) AS pos FROM conversations GROUP BY 1),
h AS (SELECT DISTINCT 'turn-' || turn AS name FROM conversations WHERE role <> 'user' UNION SELECT DISTINCT role FROM conversations WHERE conv_id % 2 = 0)
SELECT conv_id, min_by(name, pos) AS name FROM w WHERE name IN (SELECT name FROM h) GROUP BY 1""")
def first_named_hit(spark, d):
    """JN03: the first of three alternatives that exists."""
    c = t(spark, d, "conversations")
    last = F.concat(F.lit("turn-"), F.col("last").cast("string"))
    wanted = c.groupBy("conv_id").agg(F.max("turn").alias("last")).select("conv_id", F.array(F.concat(last, F.lit("-x")), F.lit("user"), last).alias("names"))
    have = c.where("role <> 'user'").select(F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("name")).union(c.where("conv_id % 2 = 0").select("role")).distinct()
    return matching.first_named(wanted, have, "conv_id", "names", "name")


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50")
def operation_payloads(spark, d):
    """SC30, SC31: the latest operations of a kind with their payload decoded."""
    ops = t(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("open").alias("status"), F.col("event_type").alias("op_type"), F.col("props").alias("payload_json"), F.col("ts").alias("updated_at"))
    return tables.operations(ops, "open", "click").select("id", F.col("payload")["k"].alias("k"))


@query("""
SELECT 'documents' AS "table", true AS there, (SELECT count(*) FROM documents) AS n_rows UNION ALL SELECT 'labels', true, (SELECT count(*) FROM labels) UNION ALL SELECT 'missing', false, NULL""")
def existing_tables(spark, d):
    """JN25, SC32: which tables of a list exist, and their rows."""
    for name in ("documents", "labels"):
        t(spark, d, name).createOrReplaceTempView(f"check_{name}")
    return tables.existing(spark, {n: f"check_{n}" for n in ("documents", "labels", "missing")})
