"""Registered queries of plans, lookups, totals and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolith.operators import actions, matching, mutate, reports
from recolith.plans.catalog import query, t


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'alac' ELSE 'flac' END AS codec, CASE WHEN p_size % 2 = 0 THEN 44100 END AS rate, CASE p_size % 4 WHEN 0 THEN 24 WHEN 1 THEN 16 WHEN 2 THEN 32 END AS bits,
       CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE p_size END AS duration, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS artist, p_name AS title FROM part""")
def probe_flattened(spark, d):
    """PF09."""
    s = F.col("p_size")
    tags = lambda a, b: F.struct(a.alias("artist"), b.alias("title"))
    stream = F.struct(F.when(s % 3 == 0, "alac").otherwise(" ").alias("codec_name"), F.when(s % 2 == 0, "44100").otherwise("N/A").alias("sample_rate"), F.when(s % 4 == 0, "24").alias("bits_per_raw_sample"), F.when(s % 4 == 1, "16").when(s % 4 != 0, "").alias("bits_per_sample"), F.when(s % 4 == 2, "s32p").alias("sample_fmt"), F.when(s % 5 == 0, F.col("p_retailprice").cast("string")).otherwise("N/A").alias("duration"), tags(F.col("p_type"), F.col("p_name")).alias("tags"))
    fmt = F.struct(s.cast("string").alias("duration"), tags(F.when(s % 2 == 0, F.col("p_brand")).otherwise(""), F.lit(None).cast("string")).alias("tags"))
    return t(spark, d, "part").select("p_partkey", actions.probe_fields(F.struct(stream.alias("stream"), fmt.alias("format")), F.lit(".flac")).alias("f")).select("p_partkey", "f.*")


_PN = "'d:/' || p_name || '/' || p_brand || CASE WHEN p_size % 4 = 0 THEN '_PN' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '.mp3' ELSE '.flac' END"


@query(f"""
WITH f AS (SELECT p_partkey, {_PN} AS path FROM part), r AS (SELECT *, replace(path, '_PN.', '.') AS target FROM f WHERE path LIKE '%_PN.%'),
p AS (SELECT r.p_partkey, r.path, target, CASE WHEN lower(target) IN (SELECT lower(path) FROM f) THEN 'blocked_target_exists' WHEN count(*) OVER (PARTITION BY lower(target)) > 1 THEN 'blocked_target_shared' ELSE 'planned' END AS status FROM r)
SELECT f.p_partkey, coalesce(p.status, 'untouched') AS status, CASE WHEN p.status = 'planned' THEN p.target ELSE f.path END AS path FROM f LEFT JOIN p USING (p_partkey)""")
def suffix_renames(spark, d):
    """PF24, SC08, DM10: names without their particle, what blocks them, and the table after the rest."""
    f = t(spark, d, "part").select("p_partkey", F.expr(_PN).alias("path"))
    plan = actions.rename_plan(f, "path")
    after = actions.apply_renames(f, "path", plan.select("path", "target", "status").distinct())
    return after.join(plan.select("p_partkey", "status"), "p_partkey", "left").select("p_partkey", F.coalesce("status", F.lit("untouched")).alias("status"), "path")


@query("""
SELECT p_partkey, 'D:/Lib/' || p_partkey || CASE p_size % 4 WHEN 2 THEN '.aif' WHEN 3 THEN '' WHEN 0 THEN '.aiff' ELSE '.wav' END AS target, p_size % 4 <> 3 AS supported FROM part
WHERE p_size % 5 <> 0 AND p_size % 2 + p_size % 3 > 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)""")
def conversion_candidates(spark, d):
    """PF21: high-resolution files under a root that no duplicate plan takes."""
    s = F.col("p_size")
    p = t(spark, d, "part").select("p_partkey", "p_size", F.concat(F.when(s % 5 == 0, "E:/Other/").otherwise("D:/Lib/"), F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".aiff"), F.lit(".wav"), F.lit(".m4a"), F.lit(".ogg")), s % 4 + 1)).alias("path"))
    ext = F.element_at(F.array(F.lit(".aiff"), F.lit(".wav"), F.lit(".m4a"), F.lit(".ogg")), s % 4 + 1)
    planned = t(spark, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("p_partkey")).distinct().join(p, "p_partkey").select("path")
    out = actions.conversion_plan(p, "path", s % 2 + s % 3 > 0, planned, F.lit("d:/lib"))
    return out.select("p_partkey", F.coalesce("target", F.regexp_replace("path", r"\.ogg$", "")).alias("target"), "supported")


@query("""
WITH n AS (SELECT p_name AS k, count(*) AS n FROM part GROUP BY 1), c AS (SELECT DISTINCT p_name AS path, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' 2' END AS target FROM part),
m AS (SELECT p_name, min(p_brand) AS target FROM part GROUP BY 1), x AS (SELECT a.p_name AS path, b.p_name AS target FROM (SELECT DISTINCT p_name, length(p_name) AS l FROM part) a JOIN (SELECT DISTINCT p_name, length(p_name) AS l FROM part) b ON b.l = a.l AND a.p_name < b.p_name)
SELECT path, target, s.n AS n_source, g.n AS n_target FROM x JOIN n s ON s.k = path JOIN n g ON g.k = target""")
def target_collisions(spark, d):
    """JN22: moves whose source and target both have rows; a move to a name without rows is none."""
    p = t(spark, d, "part")
    names = p.select("p_name").distinct().withColumn("l", F.length("p_name"))
    moves = names.select(F.col("p_name").alias("path"), "l").join(names.select(F.col("p_name").alias("target"), "l"), "l").where("path < target").drop("l")
    free = names.select(F.col("p_name").alias("path"), F.concat("p_name", F.lit(" free")).alias("target"))
    return actions.collision_guard(moves.unionByName(free), p.select(F.col("p_name").alias("path")), "path")


@query("""
SELECT 'smart' AS list, p_partkey FROM part WHERE lower(p_name) LIKE '%widget%' AND p_size BETWEEN 10 AND 30 AND p_brand <> 'Brand#1'
UNION ALL SELECT 'any', p_partkey FROM part WHERE p_retailprice > 980 OR lower(p_type) LIKE 'eco%' OR p_size = 7""")
def smart_lists(spark, d):
    """JN17: saved predicates run against the table."""
    p = t(spark, d, "part")
    a = p.where(actions.saved_predicate([("p_name", "contains", "Widget"), ("p_size", "in_range", (10, 30)), ("p_brand", "not_equal", "Brand#1")]))
    b = p.where(actions.saved_predicate([("p_retailprice", "greater", 980), ("p_type", "starts_with", "ECO"), ("p_size", "equal", 7)], match_all=False))
    return a.select(F.lit("smart").alias("list"), "p_partkey").unionByName(b.select(F.lit("any").alias("list"), "p_partkey"))


@query("""
WITH f AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 's/' || s_suppkey WHEN 1 THEN '/mnt/a/s/' || s_suppkey ELSE '/mnt/b/s/' || s_suppkey END AS path FROM supplier), r AS (SELECT DISTINCT 's/' || l_suppkey AS ref FROM lineitem UNION SELECT 's/x' || n_nationkey FROM nation)
SELECT ref, coalesce(a.path, b.path, c.path) AS found, CASE WHEN a.path IS NOT NULL THEN 0 WHEN b.path IS NOT NULL THEN 1 WHEN c.path IS NOT NULL THEN 2 END AS at
FROM r LEFT JOIN f a ON a.path = ref LEFT JOIN f b ON b.path = '/mnt/a/' || ref LEFT JOIN f c ON c.path = '/mnt/b/' || ref""")
def references_over_roots(spark, d):
    """JN23, PA08: references as they are, else under each root; the first that exists."""
    s = F.col("s_suppkey")
    f = t(spark, d, "supplier").select(F.concat(F.when(s % 3 == 0, "").when(s % 3 == 1, "/mnt/a/").otherwise("/mnt/b/"), F.lit("s/"), s.cast("string")).alias("path"))
    refs = t(spark, d, "lineitem").select(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("ref")).union(t(spark, d, "nation").select(F.concat(F.lit("s/x"), F.col("n_nationkey").cast("string")))).distinct()
    return actions.first_existing(refs, "ref", ["/mnt/a/", "/mnt/b"], f, "path")


@query("""
WITH dim AS (SELECT min(p_partkey) AS id, lower(p_brand) AS k FROM part WHERE p_size < 25 GROUP BY 2), w AS (SELECT DISTINCT p_brand AS name, lower(p_brand) AS k FROM part UNION SELECT upper(p_type), lower(p_type) FROM part),
m AS (SELECT k, (SELECT max(p_partkey) FROM part WHERE p_size < 25) + row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT k FROM w WHERE k NOT IN (SELECT k FROM dim)))
SELECT name, coalesce(dim.id, m.id) AS p_partkey, m.id IS NOT NULL AS created, dim.id AS plain_id FROM w LEFT JOIN dim ON dim.k = w.k LEFT JOIN m ON m.k = w.k""")
def lookup_or_create(spark, d):
    """JN26, JN27, JN14, JN21: ids by folded name; missing names get the next ids, or none where that is not allowed."""
    p = t(spark, d, "part")
    dim = p.where("p_size < 25").select("p_partkey", "p_brand")
    names = p.select(F.col("p_brand").alias("name")).union(p.select(F.upper("p_type"))).distinct()
    made = actions.lookup_or_create(names, "name", dim, "p_partkey", "p_brand", create=True)
    plain = actions.lookup_or_create(names, "name", dim, "p_partkey", "p_brand", create=False).select("name", F.col("p_partkey").alias("plain_id"))
    return made.join(plain, "name").select("name", "p_partkey", "created", "plain_id")


@query("""
WITH u AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN upper(p_name) || ' ' WHEN p_size % 3 = 1 THEN p_name || '!' END AS p_name, CASE WHEN p_size % 4 = 0 THEN p_size + 1 WHEN p_size % 4 = 1 THEN p_size END AS p_size FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT p_partkey, concat_ws(';', CASE WHEN u.p_name LIKE '%!' THEN 'p_name' END, CASE WHEN u.p_size <> part.p_size THEN 'p_size' END) AS changed, CASE WHEN u.p_name LIKE '%!' THEN u.p_name ELSE part.p_name END AS new_name, coalesce(u.p_size, part.p_size) AS new_size FROM part LEFT JOIN u USING (p_partkey)),
b AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 40 AS batch FROM c WHERE changed <> '')
SELECT p_partkey, new_name AS p_name, new_size AS p_size, changed, batch FROM c LEFT JOIN b USING (p_partkey)""")
def batched_updates(spark, d):
    """DM14, PF35, PF36: columns after updates, and a report row with its batch for each row that changed."""
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    s = F.col("p_size")
    u = p.where("p_partkey % 2 = 0").select("p_partkey", F.when(s % 3 == 0, F.concat(F.upper("p_name"), F.lit(" "))).when(s % 3 == 1, F.concat("p_name", F.lit("!"))).alias("p_name"), F.when(s % 4 == 0, s + 1).when(s % 4 == 1, s).alias("p_size"))
    after, report = actions.update_report(p, u, "p_partkey", ["p_name", "p_size"], batch=40)
    return after.join(report, "p_partkey", "left").select("p_partkey", "p_name", "p_size", F.coalesce("changed", F.lit("")).alias("changed"), "batch")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS plan, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'plan_replaced' ELSE 'plan_created' END END AS event,
       CASE WHEN o_orderkey % 3 = 0 THEN coalesce(nullif(o_orderpriority, '1-URGENT'), 'x') ELSE 'x' END AS destination
FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 2 = 0""")
def plan_upserts(spark, d):
    """DM17, PF27, SK12: plans with an event for each that is new or replaced, and the first payload key that says where."""
    o = t(spark, d, "orders")
    payload = F.create_map(F.lit("destination"), F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderpriority") != "1-URGENT"), F.col("o_orderpriority")).otherwise(" "), F.lit("target"), F.lit("x"))
    rows = o.select(F.col("o_orderkey").alias("id"), "o_orderstatus", actions.destination(payload).alias("destination"))
    old = rows.where("id % 2 = 0").select("id", "destination", F.lit("old").alias("plan"))
    new = rows.where("o_orderstatus = 'F'").select("id", "destination", F.lit("new").alias("plan"))
    log = spark.createDataFrame([], "id long, event string, at int")
    plans, events = actions.plan_upsert(old, log, new, "id", F.lit(1))
    return plans.join(events.select("id", "event"), "id", "left").select("id", "plan", "event", "destination")


@query("""
SELECT unnest(['added', 'found', 'relinked', 'left_behind', 'after_delete']) AS step, unnest([(SELECT count(*) FROM customer) + 3, 3, 2, 0, (SELECT count(*) FROM customer)]) AS n_rows""")
def write_smoke(spark, d):
    """DM20, DM09, DM11: rows added, found, relinked and deleted on a version of a table."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("D:/"), F.col("c_name")).alias("path"))
    new = spark.createDataFrame([(-1, "E:/in/a"), (-2, "E:/in/B"), (-3, "tidal:track:1")], "id long, path string")
    return actions.smoke(c, "id", "path", new, "e:/in", "D:/lib")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, coalesce(sum(CASE WHEN l_quantity > 10 THEN l_quantity END), 0) AS sum_applied, 0::DOUBLE AS sum_none FROM lineitem GROUP BY 1, 2""")
def plan_totals(spark, d):
    """AG14, AG17, AG21, AG23: rows and sums by status, nulls as zero."""
    x = t(spark, d, "lineitem").withColumns({"applied": F.when(F.col("l_quantity") > 10, F.col("l_quantity")), "none": F.lit(None).cast("double")})
    return actions.totals(x, "applied", "none", by=["l_returnflag", "l_linestatus"]).withColumn("sum_none", F.col("sum_none").cast("double"))


@query("""
WITH o AS (SELECT l_orderkey, l_partkey, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS place FROM lineitem), f AS (SELECT l_suppkey AS s, l_partkey, min(l_orderkey) AS first_place, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT s AS l_suppkey, count(*) AS n_distinct, sum(n) - count(*) AS n_duplicates, min(first_place) AS first_order, (SELECT count(*) FROM lineitem l JOIN f g ON g.s = l.l_suppkey AND g.l_partkey = l.l_partkey AND l.l_orderkey > g.first_place WHERE l.l_suppkey = f.s) AS n_later FROM f GROUP BY 1""")
def first_occurrences(spark, d):
    """WN10, WN11: of repeated members the first place stays; the rest are duplicates."""
    first, repeats = actions.ordered_unique(t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey"), ["l_suppkey"], "l_partkey", "l_orderkey")
    g = first.groupBy("l_suppkey").agg(F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_duplicates"), F.min("first_place").alias("first_order"))
    return g.join(repeats.groupBy("l_suppkey").agg(F.count("*").alias("n_later")), "l_suppkey", "left").withColumn("n_later", F.coalesce("n_later", F.lit(0)))


@query("""
WITH w AS (SELECT p_brand AS name FROM part UNION ALL SELECT upper(p_type) FROM part UNION ALL SELECT p_type FROM part), u AS (SELECT lower(name) AS key, min(name) AS name FROM w GROUP BY 1)
SELECT key, name, 'wanted' AS kind, NULL::BIGINT AS n FROM u UNION ALL SELECT NULL, p_type, 'type', count(*) FROM part GROUP BY p_type""")
def name_unions(spark, d):
    """SO06, SO07: names of several tables once by folded key, and reports one after the other."""
    p = t(spark, d, "part")
    wanted = actions.wanted_names(p.select("p_brand"), p.select(F.upper("p_type")), p.select("p_type"))
    return actions.report_rows(wanted=wanted, type=p.groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")))


@query("""
WITH k AS (SELECT doc_id, 'text' AS kind, md5(text) AS key FROM documents UNION ALL SELECT doc_id, 'size', n_chars::VARCHAR FROM documents UNION ALL SELECT doc_id, 'name', CASE WHEN doc_id % 2 = 0 THEN lang || source ELSE '' END FROM documents)
SELECT kind, doc_id, count(*) OVER w AS n, min(doc_id) OVER w AS first_id FROM k WHERE key <> '' WINDOW w AS (PARTITION BY kind, key) QUALIFY count(*) OVER w > 1""")
def match_groups(spark, d):
    """JN07: groups of rows by several keys at once."""
    x = t(spark, d, "documents")
    g = actions.match_groups(x, "doc_id", text=F.md5(F.encode("text", "UTF-8")), size=F.col("n_chars"), name=F.when(F.col("doc_id") % 2 == 0, F.concat("lang", "source")).otherwise(""))
    return g.select("kind", "doc_id", "n", "first_id")


@query("""
WITH s AS (SELECT unnest(['cache', 'view', 'click', 'error']) AS source), u AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT user_id, event_type AS source, count(*) FILTER (WHERE event_type <> 'error') AS n, max(CASE WHEN event_type = 'error' THEN 'failed' END) AS error FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT user_id, source, coalesce(n, 0) AS n_candidates, error, CASE WHEN error IS NOT NULL THEN 'error' WHEN n > 0 THEN 'ok' ELSE 'none' END AS status FROM u CROSS JOIN s LEFT JOIN f USING (user_id, source)""")
def source_fan_out(spark, d):
    """SI09, SC38, SC47: each item at each source, with candidates, an error or nothing."""
    e = t(spark, d, "events")
    found = e.where("event_id % 3 = 0").select("user_id", F.col("event_type").alias("source"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("candidate"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return actions.fan_out(e.select("user_id"), "user_id", ["cache", "view", "click", "error"], found)


@query("""
SELECT p_partkey, lower(trim(p_brand)) <> CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE lower(p_type) END AS update_plain, true AS update_all, p_size % 3 = 0 AS overlap FROM part""")
def tag_checks(spark, d):
    """PF37, SO10: tags that must be written, and key sets that meet."""
    s = F.col("p_size")
    wanted = F.when(s % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.col("p_type"))
    left = F.array(F.col("p_name"), F.lit(None).cast("string"), F.lit(""))
    right = F.array(F.lit(""), F.when(s % 3 == 0, F.col("p_name")), F.lit("zz"))
    return t(spark, d, "part").select("p_partkey", actions.tag_needs_update(F.col("p_brand"), wanted, False).alias("update_plain"), actions.tag_needs_update(F.col("p_brand"), wanted, True).alias("update_all"), reports.keys_overlap(left, right).alias("overlap"))


@query("""
WITH c AS (SELECT s_suppkey, 'tidal:' || s_suppkey AS path FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'D:/Old/' ELSE 'D:/Older/' END || s_name FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT s_suppkey, path LIKE 'D:/Old/%' AS changed, replace(path, 'D:/Old/', 'E:/New/') AS path, (SELECT coalesce(max(n_nationkey), 0) FROM nation) + row_number() OVER (ORDER BY s_suppkey) AS seq FROM c""")
def prefix_relinks(spark, d):
    """DM09, PF19, DM12, AG24: paths under one prefix move to another, streams stay; numbers follow the largest there is."""
    s = F.col("s_suppkey")
    path = F.when(s % 5 == 0, F.concat(F.lit("tidal:"), s.cast("string"))).when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("D:/Old/"), F.col("s_name"))).otherwise(F.concat(F.lit("D:/Older/"), F.col("s_name")))
    after, left = mutate.relink(t(spark, d, "supplier").select("s_suppkey", path.alias("path")), "path", "d:\\old\\", "E:\\New")
    top = t(spark, d, "nation").agg(F.max("n_nationkey")).first()[0]
    return mutate.append_sequence(after.join(left.select("s_suppkey"), "s_suppkey", "left_anti"), F.lit(top), [F.col("s_suppkey")]).withColumn("seq", F.col("seq").cast("long"))


@query("""
WITH p AS (SELECT DISTINCT string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/') AS parts FROM pages), w AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path, i AS depth FROM p, unnest(range(1, len(parts) + 1)) AS r(i))
SELECT path, depth::INT AS depth FROM w WHERE path NOT IN (SELECT parts[1] FROM p WHERE parts[1] LIKE 'm.%')""")
def missing_folders(spark, d):
    """GH05, GH08, SO09: every folder above a path that does not exist yet."""
    p = t(spark, d, "pages").select(F.split(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), "/").alias("parts"))
    there = p.where(F.col("parts")[0].startswith("m.")).select(F.slice("parts", 1, 1).alias("parts"))
    return mutate.missing_prefixes(p, "parts", there).select(F.array_join("parts", "/").alias("path"), "depth")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, 'p' || l_partkey AS path FROM lineitem WHERE l_quantity <= 5)
SELECT 'named' AS kind, count(*) AS n FROM a WHERE path IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 20) UNION ALL SELECT 'unnamed', count(*) FROM a WHERE path NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 20)
UNION ALL SELECT 'purged', count(*) FROM a WHERE path IN (SELECT 'p' || p_partkey FROM part WHERE p_size >= 20)""")
def resolved_names(spark, d):
    """PF39, JN24, DM19: rows that have a namesake, those that have none, and entries whose file exists."""
    a = t(spark, d, "lineitem").where("l_quantity <= 5").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"))
    p = t(spark, d, "part").select("p_size", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    yes, no = matching.resolve_named(a, p.where("p_size < 20").select("path"), "path")
    kept = mutate.purge(a, p.where("p_size >= 20"), "path")
    one = lambda k, df: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return one("named", yes).unionByName(one("unnamed", no)).unionByName(one("purged", kept))
