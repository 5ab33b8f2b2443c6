"""Further registered queries: reports, mutations, ledgers and streams' batch forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from recolith.functions import rules, values
from recolith.functions import text as tx
from recolith.operators import aggregates as ag
from recolith.operators import dedup, mutate, reports, similarity
from recolith.plans.catalog import _id_map, _IDMAP, query, t
from recolith.streaming import folds


@query("""
SELECT p_partkey, status FROM (SELECT p_partkey, CASE WHEN st = 'candidate' AND r > 100 THEN 'over_limit' ELSE st END AS status FROM (
  SELECT p_partkey, st, row_number() OVER (PARTITION BY st ORDER BY p_partkey) AS r FROM (
    SELECT p_partkey, CASE WHEN p_size < 10 THEN 'already_in_db' WHEN p_type LIKE '%TIN' THEN 'duplicate_delete_candidate' ELSE 'candidate' END AS st FROM part)))""")
def limit_with_status(spark, d):
    """PF23, SL12, JN10."""
    return reports.limit_with_status(t(spark, d, "part"), F.col("p_size") < 10, F.col("p_type").endswith("TIN"), [F.col("p_partkey")], 100).select("p_partkey", "status")


@query("""
SELECT p_partkey, CASE WHEN p_name LIKE '% %' THEN split_part(p_name, ' ', 1) ELSE p_name END AS first_word, round((floor(p_retailprice)::INT) / 100.0, 2) AS tempo FROM part""")
def track_report(spark, d):
    """PF30."""
    p = t(spark, d, "part").withColumn("bpm", F.floor("p_retailprice").cast("int")).withColumn("uri", F.concat(F.lit("file://localhost/"), F.substring_index("p_name", " ", 1)))
    return reports.track_rows(p, "uri", "bpm").select("p_partkey", F.substring_index("path", "\\", -1).alias("first_word"), "tempo")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'a%' OR p_name LIKE 'b%'")
def named_with_prefix(spark, d):
    """PF38."""
    return reports.named_with_prefix(t(spark, d, "part"), "p_name", ["a", "b"]).select("p_partkey", "p_name")


@query("""
SELECT l_orderkey, l_linenumber, conf, identity FROM (SELECT l_orderkey, l_linenumber, round(1 - l_tax, 2) AS conf, l_discount * 10 AS identity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY round(1 - l_tax, 2) DESC, l_discount * 10 DESC, l_linenumber, l_partkey) AS r FROM lineitem WHERE l_returnflag <> 'R' AND l_discount * 10 >= 0.55) WHERE r = 1""")
def best_candidate(spark, d):
    """WN06."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(1 - F.col("l_tax"), 2).alias("conf"), (F.col("l_discount") * 10).alias("identity"), (F.col("l_returnflag") != "R").alias("has_genre"), F.struct("l_linenumber", "l_partkey").alias("o"))
    return reports.best_candidate(li, "l_orderkey", "conf", "identity", "o").select("l_orderkey", "l_linenumber", "conf", "identity")


@query("""
WITH u AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS unit FROM documents), n AS (SELECT unit, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1)
SELECT u.doc_id, u.unit AS component, n.n AS n_members FROM u JOIN n ON u.unit = n.unit""")
def component_members(spark, d):
    """GH02: units are equal texts, and no unit is linked to another."""
    x = t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    u = x.join(x.groupBy("h").agg(F.min("doc_id").alias("unit")), "h").select("doc_id", "unit")
    none = spark.createDataFrame([], "node long, component long")
    return reports.component_members(u, none, "unit").select("doc_id", "component", "n_members")


@query("""
SELECT p_partkey, list_has_any(string_split(p_name, ' '), [lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'cold' ELSE 'widget' END, p_brand]) AS overlap FROM part""")
def keys_overlap(spark, d):
    """SO10: blanks and nulls never overlap."""
    right = F.array(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "cold").otherwise("widget"), F.col("p_brand"), F.lit(""), F.lit(None).cast("string"))
    left = F.concat(F.split("p_name", " "), F.array(F.lit(""), F.lit(None).cast("string")))
    return t(spark, d, "part").select("p_partkey", reports.keys_overlap(left, right).alias("overlap"))


@query(f"""
WITH m AS ({_IDMAP}), l AS (SELECT coalesce(new_id, l_partkey) AS k, count(*) AS n, count(new_id) AS moved FROM lineitem LEFT JOIN m ON old_id = l_partkey GROUP BY 1)
SELECT p_partkey, p_name, coalesce(n, 0) AS n_links, coalesce(moved, 0) AS n_moved FROM part LEFT JOIN l ON k = p_partkey WHERE p_partkey NOT IN (SELECT old_id FROM m)""")
def merge_entities(spark, d):
    """DM01, DM03: links follow the id map, losers go."""
    m = _id_map(spark, d)
    links = t(spark, d, "lineitem").select("l_partkey").withColumn("was", F.col("l_partkey"))
    n = mutate.repoint(links, m, "l_partkey").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_links"), F.count_if(F.col("was") != F.col("l_partkey")).alias("n_moved"))
    out = mutate.merge_entities(t(spark, d, "part"), m, "p_partkey").join(n, "p_partkey", "left")
    return out.select("p_partkey", "p_name", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_moved", F.lit(0)).alias("n_moved"))


@query("""
SELECT c_custkey AS old_id, 2000000 + n_regionkey AS new_id FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 1000000 + n_nationkey, 2000000 + n_regionkey FROM nation""")
def chained_merges(spark, d):
    """DM04: chains of merges (customer, nation, region) resolve to one survivor, the largest id."""
    e = t(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + 1000000).cast("long").alias("b"))
    e = e.union(t(spark, d, "nation").select((F.col("n_nationkey") + 1000000).cast("long"), (F.col("n_regionkey") + 2000000).cast("long")))
    ids = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    return mutate.survivors(e, "a", "b", ids, "id", [-F.col("id")])


@query("""
WITH w AS (SELECT DISTINCT o_orderpriority AS scope, o_custkey AS id FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT DISTINCT o_orderpriority AS scope, o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT scope, id, false AS stale FROM w UNION ALL SELECT scope, id, true FROM (SELECT * FROM c EXCEPT SELECT * FROM w))
SELECT scope, id, stale, row_number() OVER (PARTITION BY scope ORDER BY stale, id) AS track_no FROM a""")
def mirror_keep_stale(spark, d):
    """DM07, DM08, WN08."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_custkey").alias("id"), "o_orderstatus")
    out = mutate.mirror(o.where("o_orderstatus = 'O'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus"), "scope", "id", [F.col("id")], remove_stale=False)
    return out.select("scope", "id", "stale", F.col("track_no").cast("long").alias("track_no"))


_ROWS = "SELECT p_partkey, CASE WHEN p_size < 25 THEN 'old/' ELSE 'lib/' END || p_name || '/' || p_brand AS path, p_size FROM part"


@query(f"""
WITH r AS ({_ROWS}), n AS (SELECT path AS target, count(*) AS n, min(p_partkey) AS target_id FROM r GROUP BY 1), l AS (SELECT l_partkey, count(*) AS refs FROM lineitem WHERE l_quantity > 49 GROUP BY 1),
a AS (SELECT r.*, CASE WHEN p_size % 3 > 0 THEN replace(path, 'old/', 'lib/') END AS target FROM r WHERE path LIKE 'old/%'),
x AS (SELECT a.*, n.target_id, CASE WHEN a.target IS NOT NULL AND n > 0 THEN 'auto_relink_merge' WHEN a.target IS NOT NULL THEN 'auto_relink_only' WHEN coalesce(refs, 0) = 0 THEN 'auto_delete_unreferenced_missing' ELSE 'review' END AS action FROM a LEFT JOIN n USING (target) LEFT JOIN l ON l_partkey = p_partkey)
SELECT r.p_partkey, coalesce(action, 'none') AS action, CASE WHEN action IN ('auto_relink_merge', 'auto_delete_unreferenced_missing') THEN NULL WHEN action = 'auto_relink_only' THEN target ELSE r.path END AS path,
       CASE action WHEN 'auto_relink_merge' THEN target_id WHEN 'auto_delete_unreferenced_missing' THEN NULL ELSE r.p_partkey END AS survivor FROM r LEFT JOIN x USING (p_partkey)""")
def missing_actions(spark, d):
    """PF25, DM05: rows whose file is missing are merged into the row of its new place, relinked, deleted or left for review."""
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") < 25, "old/").otherwise("lib/"), "p_name", F.lit("/"), "p_brand").alias("path"), "p_size")
    refs = t(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("refs"))
    wanted = rows.where("path LIKE 'old/%'").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.regexp_replace("path", "^old/", "lib/")).alias("target"))
    plan = mutate.plan_missing(rows.select("p_partkey", "path"), wanted, refs, "p_partkey", "path")
    after, id_map = mutate.apply_missing(rows.select("p_partkey", "path"), plan, "p_partkey", "path")
    out = rows.select("p_partkey").join(plan.select("p_partkey", "action"), "p_partkey", "left").join(after, "p_partkey", "left").join(id_map.select(F.col("old_id").alias("p_partkey"), "new_id"), "p_partkey", "left")
    return out.select("p_partkey", F.coalesce("action", F.lit("none")).alias("action"), "path", F.coalesce("new_id", F.when(F.col("path").isNotNull(), F.col("p_partkey"))).alias("survivor"))


@query("""
SELECT o_orderpriority AS crate, o_orderkey AS pos, path FROM (
  SELECT *, sum(1) OVER (PARTITION BY o_orderpriority, path ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (
    SELECT o_orderpriority, o_orderkey, o_custkey % 3 = 0 AS moved, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS path FROM orders)) WHERE NOT (moved AND coalesce(e, 0) > 0)""")
def crate_reroute(spark, d):
    """DM19, H07."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("crate"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("path"))
    r = t(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("loser"), (F.col("o_custkey") + 1).alias("keeper")).distinct()
    return mutate.reroute(o, r, "crate", "pos", "path").select("crate", "pos", "path")


@query("""
SELECT l_returnflag, list_aggregate(list(k ORDER BY o, k), 'string_agg', ',') AS resources, count(*) AS n FROM (SELECT l_returnflag, l_suppkey AS k, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def grouped_resources(spark, d):
    """AG20, AG10."""
    li = t(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_orderkey")
    return ag.grouped_resources(li, "l_returnflag", "l_suppkey", "l_orderkey").select("l_returnflag", F.concat_ws(",", F.col("resources").cast("array<string>")).alias("resources"), "n")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, d):
    """WN04, SC21."""
    return dedup.last_wins(t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id").select("user_id", "event_id", "value")


@query("""
SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_size::VARCHAR ELSE '' END AS energy, CASE WHEN p_size <= 10 THEN 'numeric' ELSE 'occupied' END AS comment_status,
  CASE WHEN p_size * 10.5 BETWEEN 20 AND 400 THEN round_even(p_size * 10.5 * 100, 0)::INT END AS bpm FROM part""")
def parsed_numbers(spark, d):
    """NU02, PF12, PF13."""
    s = F.col("p_size").cast("string")
    bpm = F.concat(F.col("p_size") * F.lit(10.5).cast("double"), F.lit(" bpm"))
    return t(spark, d, "part").select("p_partkey", values.energy(s).alias("energy"), values.comment_status(s).alias("comment_status"), values.parse_bpm(bpm).alias("bpm"))


@query("""
SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(lower(p_type || ';' || p_name), '[,;/| ]+'), lambda x: x <> ''))), 'string_agg', ';') AS genres,
  CASE WHEN p_brand LIKE '%1' THEN 'high' WHEN p_brand LIKE '%2' THEN 'medium' ELSE 'low' END AS confidence FROM part""")
def genre_terms(spark, d):
    """HB04, TX21, SC18."""
    g = F.array_distinct(tx.genre_list(F.lower(F.concat_ws(";", "p_type", "p_name")), "[,;/| ]+"))
    c = F.when(F.col("p_brand").endswith("1"), " HIGH").when(F.col("p_brand").endswith("2"), "Medium").otherwise("?")
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(g), ";").alias("genres"), tx.confidence(c).alias("confidence"))


@query("""
WITH q AS (SELECT p_partkey, ['musicbrainz', 'discogs', 'itunes', 'existing_tag', 'unheard_of'][p_size % 5 + 1] AS source, [0.78, 0.86, 0.58, 0.90, 0.5][p_size % 5 + 1] AS w, p_partkey % 3 > 0 AS has_genre, (p_size % 2 = 0)::INT AS a, (p_size % 7 > 2)::INT AS t FROM part),
s AS (SELECT *, (a + t) / 2.0 AS identity_score, round_even(least(1.0, (a + t) / 2.0 * w + CASE WHEN has_genre THEN 0.08 ELSE 0 END), 4) AS c FROM q)
SELECT p_partkey, source, a::DOUBLE AS artist_score, t::DOUBLE AS title_score, identity_score::DOUBLE AS identity_score, c::DOUBLE AS candidate_confidence,
       CASE WHEN NOT has_genre THEN 'identity_only' WHEN c >= 0.78 THEN 'high' WHEN c >= 0.58 THEN 'medium' ELSE 'low' END AS label FROM s""")
def resolver_labels(spark, d):
    """NU08, SI04, SI05, SI06: scores and labels of candidates that agree wholly, in one of two artists, or not at all."""
    s = F.col("p_size")
    source = F.element_at(F.array(*[F.lit(x) for x in ("musicbrainz", "discogs", "itunes", "existing_tag", "unheard_of")]), s % 5 + 1)
    pairs = t(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" & Xyz")).alias("artist"), F.concat("p_name", F.lit(" (Mix)")).alias("title_raw"), F.col("p_name").alias("title_clean"), F.when(s % 2 == 0, "xyz").otherwise("000").alias("matched_artist"), F.when(s % 7 > 2, F.upper("p_name")).otherwise("000").alias("matched_title"), source.alias("source"), (F.col("p_partkey") % 3 > 0).alias("has_genre"))
    out = similarity.candidate_scores(pairs)
    return out.select("p_partkey", "source", "artist_score", "title_score", "identity_score", "candidate_confidence", F.col("candidate_confidence_label").alias("label"))


@query("""
SELECT event_type AS platform, count(*) AS n_events, count(*) FILTER (WHERE value > 150) AS n_ok, count(*) FILTER (WHERE value <= 20) AS n_error, count(*) FILTER (WHERE value > 20 AND value <= 30) AS n_skipped, count(*) FILTER (WHERE value > 30 AND value <= 150) AS n_other FROM events GROUP BY 1""")
def running_totals(spark, d):
    """ST06, AG22: the stream's counters over the whole log."""
    v = F.col("value")
    e = t(spark, d, "events").select(F.col("event_type").alias("platform"), F.when(v > 150, "OK").when(v <= 20, "Error").when(v <= 30, "skipped").otherwise("else").alias("status"), F.col("user_id").cast("string").alias("path"))
    return folds.running_totals(e).drop("n_paths_about")


@query("""
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, m.n AS n_user FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) m USING (user_id) GROUP BY 1, 2, 5""")
def windowed_totals(spark, d):
    """ST05, SL11: the stream's day windows and message counts over the whole log, for the twenty most frequent."""
    e = t(spark, d, "events").withColumn("message", F.col("user_id").cast("string"))
    top = folds.message_totals(e).orderBy(F.desc("n"), F.col("message").cast("long")).limit(20).select("message", F.col("n").alias("n_user"))
    rows = e.join(top, "message").withColumn("key", F.concat_ws("|", "event_type", F.col("n_user").cast("string")))
    out = folds.windowed_totals(rows, by="key")
    parts = F.split("key", r"\|")
    return out.select(F.col("window.start").alias("day"), parts[0].alias("event_type"), "n", F.round("total", 4).alias("total"), parts[1].cast("long").alias("n_user"))


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS id, 'x' || (p_partkey // 4 * 4) AS up FROM part)
SELECT p_partkey, id LIKE 'x%' AS renamed, true AS numeric_id, up IN (SELECT id FROM n) AS parent_found, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_links FROM n""")
def rekeyed_nodes(spark, d):
    """GH06, GH07: ids that are not numbers get unused ones; parents and links follow."""
    k = F.col("p_partkey").cast("string")
    n = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("x"), k)).otherwise(k).alias("id"), F.concat(F.lit("x"), (F.floor(F.col("p_partkey") / 4) * 4).cast("string")).alias("up"))
    links = t(spark, d, "lineitem").select("l_partkey").join(n.select(F.col("p_partkey").alias("l_partkey"), "id"), "l_partkey").select("id")
    id_map, nodes, moved = mutate.rekey(n, links, "id", "up", "id")
    counts = moved.groupBy("id").agg(F.count("*").alias("n_links"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("parent_found")).distinct()
    out = nodes.join(counts, "id", "left").join(known, "up", "left").join(id_map.select(F.col("new_id").alias("id"), F.lit(True).alias("renamed")), "id", "left")
    return out.select("p_partkey", F.coalesce("renamed", F.lit(False)).alias("renamed"), F.col("id").rlike("^[0-9]+$").alias("numeric_id"), F.coalesce("parent_found", F.lit(False)).alias("parent_found"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("""
WITH k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_brand DESC, p_name DESC, p_partkey) AS a FROM part), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS b, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS c, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS e FROM orders),
g AS (SELECT p_name, row_number() OVER (ORDER BY count(*) DESC, p_name) AS n FROM part GROUP BY 1)
SELECT 'liked' AS kind, o_orderkey::VARCHAR AS id FROM o WHERE b <= 25 UNION ALL SELECT 'membership', o_orderkey::VARCHAR FROM o WHERE c <= 25 UNION ALL SELECT 'operations', o_orderkey::VARCHAR FROM o WHERE e <= 25 UNION ALL SELECT 'playlists', p_name FROM g WHERE n <= 25
UNION ALL SELECT 'plan', p FROM (SELECT DISTINCT lower(p_name) AS p FROM part ORDER BY 1 LIMIT 25) UNION ALL SELECT 'keep', k FROM (SELECT p_size || '/' || p_retailprice AS k FROM part GROUP BY p_size, p_retailprice ORDER BY p_size DESC, p_retailprice DESC LIMIT 25)""")
def ordered_reports(spark, d):
    """SL03, SL06, SL07, SL08, SL09, SL10, SL13: the first 25 of each report in its order; the limit is the feature."""
    p, o = t(spark, d, "part"), t(spark, d, "orders")
    one = lambda kind, df, code, c: reports.ordered(df, code, 25).select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    keep = p.select(F.col("p_size").alias("quality_score"), F.col("p_retailprice").alias("size")).distinct().withColumns({"mtime": F.lit(0), "path": F.concat(F.col("quality_score").cast("string"), F.lit("/"), F.col("size").cast("string"))})
    parts = [
        one("keep", keep, "SL03", "path"),
        one("playlists", p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")), "SL06", "name"),
        one("liked", o.select(F.col("o_orderdate").alias("liked_at"), F.col("o_orderkey").alias("id")), "SL07", "id"),
        one("plan", p.select(F.lower("p_name").alias("path")).distinct(), "SL08", "path"),
        one("membership", o.select(F.col("o_custkey").alias("track_no"), F.col("o_orderkey").alias("id")), "SL09", "id"),
        one("operations", o.select(F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("id")), "SL10", "id"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""
SELECT * FROM (VALUES ('src_artist_name', 'srcartistname|src artist name|src_artist_name|artistname|artist name|artist_name|artist|srcsrcartistname|src_src_artist_name'), ('Genre', 'genre|srcgenre|src_genre'), ('F# minor', 'f#m|f#'), ('A♭ major / C min', 'ab|cm|c'), ('sources', 'b|a')) AS v(field, spellings)""")
def spelled_names(spark, d):
    """TX19, TX20, PF40, PF43: spellings of fields and keys, and sources in the order asked for."""
    rows = [(f, "|".join(tx.field_aliases(f))) for f in ("src_artist_name", "Genre")] + [(k, "|".join(tx.key_variants(k))) for k in ("F# minor", "A♭ major / C min")]
    rows.append(("sources", "|".join(reports.enabled_sources({"a": {}, "b": {"enabled": True}, "c": {"enabled": False}}, ["b", "c", "a"]))))
    return reports.strip_private(spark.createDataFrame(rows, "field string, spellings string").withColumn("_order", F.lit(1)))


@query("SELECT 'orders' AS \"table\", count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def table_status(spark, d):
    """SC32."""
    from recolith.sources.tables import table_status as status

    return status({n: t(spark, d, n) for n in ("orders", "part", "events")})


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_operations(spark, d):
    """SC31, SL10: the 50 latest; the limit is the report."""
    ev = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    return reports.ordered(ev, "SL10", 50).select(F.col("id").alias("event_id"), F.col("updated_at").alias("ts"))
