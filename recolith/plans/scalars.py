"""Registered queries of the scalar functions: text keys, paths, numbers, maps and decision ladders.

Inputs are built from the tables by expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recolith.functions import paths as pa
from recolith.functions import rules, values
from recolith.functions import text as tx
from recolith.operators import reports
from recolith.plans.catalog import query, t

#: A title in one of several shapes.
TITLE = "CASE p_size % 8 WHEN 0 THEN p_name || ' (Original Mix)' WHEN 1 THEN p_name || ' feat. ' || p_brand WHEN 2 THEN p_name || ' [Radio Edit]' WHEN 3 THEN p_name || ' - 2011 Remastered' WHEN 4 THEN p_name || ' & ' || p_type || ' (Explicit)' WHEN 5 THEN upper(p_name) || '  Extended   Club Mix' WHEN 6 THEN p_name || ' (' || p_type || ')' ELSE p_name END"
ARTIST = "CASE p_size % 5 WHEN 0 THEN 'The ' || p_brand || ' & ' || p_type WHEN 1 THEN p_type || ' x ' || p_name WHEN 2 THEN p_brand || ', ' || p_type || ' feat. ' || p_name WHEN 3 THEN p_type || ' + ' || p_brand ELSE p_brand END"
#: A file address with a host or without, a detour, an escape and one of four extensions.
PATH = "'file://' || CASE p_size % 3 WHEN 0 THEN 'localhost' WHEN 1 THEN '' ELSE 'nas' END || '/D:/Lib/' || p_type || '/x/../' || replace(p_name, ' ', '%20') || CASE p_size % 4 WHEN 0 THEN '.aiff' WHEN 1 THEN '.WAV' WHEN 2 THEN '.m4a' ELSE '.flac' END"
WORDS = "original|extended|radio|club|clean|dirty|explicit|instrumental|vocal|dub|edit|mix|remix|remaster|remastered|version"


def _alnum(s: str, join: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'), '\s+', '{join}', 'g'))"


def _feat(s: str) -> str:
    return rf"regexp_replace(replace({s}, '&', ' and '), '\b(feat|featuring|ft)\.?\b', ' feat ', 'g')"


def _sp(s: str) -> str:
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


_BARE = rf"regexp_replace(lower({TITLE}), '[\[(].*?[\])]', ' ', 'g')"


@query(rf"""
SELECT p_partkey, {_alnum(_feat(rf"regexp_replace({_BARE}, '\b({WORDS}|master)\b', ' ', 'g')"), "")} AS loose,
       {_alnum(_feat(rf"regexp_replace({_BARE}, '\b({WORDS})\b', ' ', 'g')"), "")} AS loose_plain,
       {_alnum(rf"regexp_replace(regexp_replace({_feat(f'lower({TITLE})')}, '\b(explicit|clean|dirty)\b', ' ', 'g'), '\b(\d{{4}}\s*)?remaster(ed|ise|ised|ize|ized)?\b', ' ', 'g')", "")} AS safe,
       {_alnum(rf"regexp_replace(lower({TITLE}), '\b({WORDS})\b', ' ', 'g')", "")} AS stem FROM part""")
def title_keys(spark, d):
    """TX02, TX03, TX04."""
    s = F.expr(TITLE)
    return t(spark, d, "part").select("p_partkey", tx.loose_title_key(s).alias("loose"), tx.loose_title_key(s, master=False).alias("loose_plain"), tx.safe_title_key(s).alias("safe"), tx.stem_key(s).alias("stem"))


_MATCH = _alnum(rf"regexp_replace(replace(lower({ARTIST}), '&', ' and '), '\b(feat|featuring|ft)\.?\b', ' ', 'g')", " ")
_STRIP = _sp(rf"regexp_replace(regexp_replace({TITLE}, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '(?i)\b(original|extended|radio|club|edit|mix|remaster(?:ed)?)\b', ' ', 'g')")


@query(rf"""
SELECT p_partkey, {_MATCH} AS match_text, replace({_MATCH}, ' ', '') AS match_key, {_STRIP} AS stripped,
       array_to_string(list_sort(list_filter(list_distinct(string_split({_MATCH}, ' ')), lambda x: x NOT IN ('', 'and', 'the', 'feat', 'ft', 'featuring', 'vs', 'x'))), '|') AS tokens FROM part""")
def match_texts(spark, d):
    """TX06, TX07, TX08."""
    a, s = F.expr(ARTIST), F.expr(TITLE)
    return t(spark, d, "part").select("p_partkey", tx.match_text(a).alias("match_text"), tx.match_key(a).alias("match_key"), tx.strip_version(s).alias("stripped"), F.array_join(F.array_sort(tx.artist_tokens(a)), "|").alias("tokens"))


_SPLIT = f"{ARTIST} || ' - ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' - B_processed' ELSE '' END"


@query(rf"""
WITH s AS (SELECT p_partkey, {_SPLIT} AS s, {ARTIST} AS a FROM part),
c AS (SELECT *, trim(regexp_replace(s, '(?i)_processed$', '')) AS c, {_sp("s")} AS w FROM s)
SELECT p_partkey, trim(substr(c, 1, strpos(c, ' - ') - 1)) AS artist, trim(substr(c, strpos(c, ' - ') + 3)) AS title,
       trim(regexp_extract(w, '^(.*?)\s+-\s+', 1)) AS dashed_artist, trim(regexp_replace(w, '^.*?\s+-\s+', '')) AS dashed_title,
       array_to_string(list_filter(list_transform(string_split_regex(a, '(?i)\s*(?:,|&|\+|\bx\b|\bfeat\.?\b|\bft\.?\b)\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts,
       nullif(trim(string_split_regex({_sp("a")}, '(?i)\s+(?:&|\+|,|x|feat\.?|featuring)\s+')[1]), '') AS primary_artist FROM c""")
def split_names(spark, d):
    """TX07, TX11, TX18."""
    s, a = F.expr(_SPLIT), F.expr(ARTIST)
    p = t(spark, d, "part").select("p_partkey", tx.split_first(s).alias("x"), tx.split_dashed(s).alias("y"), F.array_join(tx.artist_parts(a), "|").alias("parts"), tx.primary_artist(a).alias("primary_artist"))
    return p.select("p_partkey", "x.artist", "x.title", F.col("y.artist").alias("dashed_artist"), F.col("y.title").alias("dashed_title"), "parts", "primary_artist")


def _identity(s: str) -> str:
    dropped = rf"regexp_replace(lower({s}), '\b(explicit|clean|radio edit|original mix|remaster(?:ed)?|processed_library_root notes?)\b', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({dropped}, '_+', ' ', 'g'), '[^\w\s&''+.-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
SELECT p_partkey, {_identity(TITLE)} AS folded, regexp_replace({_identity(ARTIST)} || ' - ' || {_identity(TITLE)}, '^[ -]+|[ -]+$', '', 'g') AS key,
       trim(regexp_replace(regexp_replace(regexp_replace(lower({TITLE}), '_+', ' ', 'g'), '\s+', ' ', 'g'), '[^\w\s&''+.-]', '', 'g')) AS kept FROM part""")
def identity_keys(spark, d):
    """TX09, TX10."""
    s, a = F.expr(TITLE), F.expr(ARTIST)
    return t(spark, d, "part").select("p_partkey", tx.identity_text(s).alias("folded"), tx.identity_key(a, s).alias("key"), tx.identity_text(s, folded=False, drop=False).alias("kept"))


_PN = "p_name || CASE p_size % 3 WHEN 0 THEN '_PN' WHEN 1 THEN '  pn' ELSE '' END"


@query(rf"""
SELECT p_partkey, lower({_sp(rf"regexp_replace(regexp_replace(regexp_replace({_sp(ARTIST)}, '[&+]', ' and ', 'g'), '[''`´’]', '', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')")}) AS taxonomy,
       lower({_sp(TITLE)}) AS plain, lower({_sp(rf"regexp_replace({_PN}, '(?i)[_\s]+pn$', '')")}) AS stem,
       regexp_replace({_PN} || '.flac', '(?i)[_\s]pn\.', '.') AS file_name,
       lower(regexp_extract(url, '([0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}})', 1)) AS uuid
FROM (SELECT *, 'https://x.example/browse/' || upper(substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21, 12)) || '?q=1' AS url FROM part)""")
def stem_keys(spark, d):
    """TX12, TX13, TX14, TX15, TX17."""
    m = F.md5(F.encode("p_name", "UTF-8"))
    url = F.concat(F.lit("https://x.example/browse/"), F.upper(F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])), F.lit("?q=1"))
    pn = F.expr(_PN)
    return t(spark, d, "part").select("p_partkey", tx.taxonomy_key(F.expr(ARTIST)).alias("taxonomy"), tx.plain_key(F.expr(TITLE)).alias("plain"), tx.canonical_stem(pn).alias("stem"), tx.without_particle(F.concat(pn, F.lit(".flac"))).alias("file_name"), tx.playlist_uuid(url).alias("uuid"))


_TOKENS = "club|clean|dirty|dub|edit|extended|instrumental|live|master|mix|original|radio|remaster|remastered|remix|version|vocal"


@query(rf"""
WITH s AS (SELECT p_partkey, {TITLE} AS s, '<Genre(1 Name=' || p_type || CASE WHEN p_size % 2 = 0 THEN ' (old)' ELSE '' END || ')>' AS g FROM part),
v AS (SELECT *, trim(regexp_replace(regexp_replace(s, '(?i)[\[(](?:[^\])]*[^a-z0-9\])])?(?:{_TOKENS})(?:[^a-z0-9\])][^\])]*)?[\])]', ' ', 'g'), '\s+', ' ', 'g'), ' -_') AS clean, {_sp("regexp_replace(regexp_replace(g, '^<[A-Za-z0-9_]+[(][^)]*Name=', ''), '[)>]+$', '')")} AS h FROM s)
SELECT p_partkey, coalesce(nullif(clean, ''), s) AS clean, trim(regexp_extract(s, '(?i)[\[(]((?:[^\])]*[^a-z0-9\])])?(?:{_TOKENS})(?:[^a-z0-9\])][^\])]*)?)[\])]', 1)) AS version,
       CASE WHEN contains(h, '(') AND trim(split_part(h, '(', 1)) <> '' THEN trim(split_part(h, '(', 1)) ELSE h END AS genre FROM v""")
def split_versions(spark, d):
    """PF31, PF32."""
    g = F.expr("'<Genre(1 Name=' || p_type || CASE WHEN p_size % 2 = 0 THEN ' (old)' ELSE '' END || ')>'")
    p = t(spark, d, "part").select("p_partkey", tx.split_version(F.expr(TITLE)).alias("v"), tx.clean_genre(g).alias("genre"))
    return p.select("p_partkey", "v.clean", "v.version", "genre")


@query(rf"""
WITH s AS (SELECT p_partkey, {ARTIST} AS artist_raw, p_name || CASE WHEN p_size % 2 = 0 THEN ' (Club Mix)' ELSE '' END AS title_raw FROM part),
x AS (SELECT *, list_filter(list_transform(string_split_regex(artist_raw, '(?i)\s*(?:,|&|\+|\bx\b|\bfeat\.?\b|\bft\.?\b)\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts, trim(replace(title_raw, ' (Club Mix)', '')) AS title_clean FROM s)
SELECT p_partkey, '.flac' AS extension, artist_raw, title_raw, title_clean, CASE WHEN title_raw LIKE '%Club Mix%' THEN 'Club Mix' ELSE '' END AS version_token, len(parts) AS artist_count,
       array_to_string(parts[2:], '; ') AS featured_artists, {_alnum(_feat("lower(artist_raw)"), "")} AS normalized_artist_key, {_alnum(_feat("lower(title_clean)"), "")} AS normalized_title_key,
       false AS has_non_ascii, title_raw LIKE '%Club Mix%' OR len(list_intersect(string_split({_alnum(_feat("lower(title_raw)"), " ")}, ' '), string_split('{_TOKENS}', '|'))) > 0 AS has_version_token FROM x""")
def track_names(spark, d):
    """PF33."""
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("D:\\Lib\\"), F.expr(ARTIST), F.lit(" - "), F.col("p_name"), F.expr("CASE WHEN p_size % 2 = 0 THEN ' (Club Mix)' ELSE '' END"), F.lit(".FLAC")).alias("path"))
    return reports.parse_track_names(p, "path").drop("path")


_TAIL = "'Lib\\' || p_type || '\\' || p_name || CASE p_size % 4 WHEN 0 THEN '.aiff' WHEN 1 THEN '.WAV' WHEN 2 THEN '.m4a' ELSE '.flac' END"


@query(rf"""
WITH s AS (SELECT p_partkey, p_type, p_size, {_TAIL} AS tail, CASE p_size % 4 WHEN 0 THEN '.aiff' WHEN 1 THEN '.wav' WHEN 2 THEN '.m4a' ELSE '.flac' END AS ext FROM part)
SELECT p_partkey, 'D:\' || replace(tail, 'Lib\' || p_type || '\', 'Lib\' || p_type || '\x\..\') AS local_path,
       CASE WHEN p_size % 3 = 2 THEN '\\nas\d:\' ELSE 'd:\' END || lower(tail) AS normal, ext AS extension,
       p_size % 3 <> 2 AND lower(p_type) LIKE 'e%' AS below, 'E:/new/' || replace(p_type, '\', '/') || substr(replace(tail, '\', '/'), length('Lib/' || p_type) + 1) AS swapped,
       p_type AS part_after, CASE ext WHEN '.aiff' THEN 'pcm_s16be' WHEN '.wav' THEN 'pcm_s16le' WHEN '.m4a' THEN 'pcm_s16be' ELSE 'flac' END AS codec,
       CASE ext WHEN '.m4a' THEN 'm4a_flac_to_aif' ELSE 'replace_in_place' END AS mode FROM s""")
def path_forms(spark, d):
    """PA02, PA03, PA06, PA10, PF02, WN17."""
    u, plain = F.expr(PATH), F.concat(F.lit("D:\\"), F.expr(_TAIL.replace("\\", "\\\\")))
    c = pa.conversion(plain)
    return t(spark, d, "part").select("p_partkey", pa.from_uri(u, host=False).alias("local_path"), pa.normal(u).alias("normal"), pa.extension(plain).alias("extension"), F.exists(F.array(*[pa.under(pa.normal(u), F.lower(F.lit(f"d:\\lib\\{x}"))) for x in ("economy",)]), lambda x: x).alias("below"), pa.swap_prefix(plain, "d:\\lib", "E:\\new").alias("swapped"), pa.part_after(plain, "lib").alias("part_after"), c["codec"].alias("codec"), c["mode"].alias("mode"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, 'd:/' || l_partkey || '.flac' AS target, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN target ELSE 'd:/' || l_partkey || '__dup' || (k + 1) || '.flac' END AS dup, CASE WHEN k = 0 THEN target ELSE 'd:/' || l_partkey || ' (CD quality ' || (k + 1) || ').flac' END AS quality,
       CASE WHEN k = 0 THEN target ELSE 'd:/' || l_partkey || '_' || right('00' || k, 3) || '.flac' END AS padded FROM s WHERE k < 999""")
def free_names(spark, d):
    """PA07: numbered names of files that want one target."""
    x = t(spark, d, "lineitem").withColumn("target", F.concat(F.lit("d:/"), F.col("l_partkey").cast("string"), F.lit(".flac")))
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    out = x.select("l_orderkey", "l_linenumber", *[pa.free_name(F.col("target"), order, s).alias(s) for s in ("dup", "quality", "padded")])
    return out.where(~F.col("padded").rlike(r"_\d{4,}\.flac$"))


@query("""
SELECT p_partkey, p_size % 4 = 0 AS streaming, (p_size % 3 = 0)::INT AS in_all, lower(replace(replace('D:\\Lib/' || p_name, '\\\\', '\\'), '\\', '/')) AS path, (p_retailprice * 100)::BIGINT AS size, p_size::BIGINT AS mtime_ns, 180::BIGINT AS win FROM part""".replace("\\\\", "\\"))
def path_flags(spark, d):
    """PF01, PF41, PA05, PA09."""
    uri = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Tidal:track:"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("file://tidal:/"), F.col("p_name")))
    folder = F.concat(F.lit("D:\\Lib\\"), F.when(F.col("p_size") % 3 == 0, "_ALL").otherwise("_all2"), F.lit("/"), F.col("p_name"))
    s = pa.signature(F.concat(F.lit("D:\\Lib/"), F.col("p_name")), F.round(F.col("p_retailprice") * 100), "p_size", F.lit(180))
    return t(spark, d, "part").select("p_partkey", tx.is_streaming(uri).alias("streaming"), pa.in_all_folder(folder).alias("in_all"), s.alias("s")).select("p_partkey", "streaming", "in_all", "s.path", "s.size", "s.mtime_ns", F.col("s.window").alias("win"))


@query(r"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN -value ELSE user_id END AS as_double,
       CASE event_id % 4 WHEN 0 THEN trunc(value)::BIGINT WHEN 1 THEN NULL WHEN 2 THEN -trunc(value)::BIGINT ELSE user_id END AS as_long,
       CASE WHEN event_id % 3 = 0 THEN 1990 + event_id % 30 END::INT AS year, CASE WHEN event_id % 3 = 1 THEN event_id % 20000 END AS int_value,
       CASE WHEN event_id % 12000 <= 9999 THEN event_id % 12000 END AS track, CASE WHEN value > 0 THEN round_even(value, 0)::INT END AS seconds, epoch_us(ts) AS at
FROM events""")
def lenient_numbers(spark, d):
    """NU01, NU02, NU04."""
    i, v = F.col("event_id"), F.col("value")
    num = F.when(i % 4 == 0, v.cast("string")).when(i % 4 == 1, "N/A").when(i % 4 == 2, F.concat(F.lit("-"), v.cast("string"))).otherwise(F.col("user_id").cast("string"))
    text = F.when(i % 3 == 0, F.concat(F.lit("ca. "), (1990 + i % 30).cast("string"), F.lit("?"))).when(i % 3 == 1, F.concat(F.lit("no "), (i % 20000).cast("string"))).otherwise("none")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(i % 3 == 0, "Z").when(i % 3 == 1, "+0000").otherwise("+00:00"))
    return t(spark, d, "events").select("event_id", values.as_double(num).alias("as_double"), values.as_long(num).alias("as_long"), F.when(i % 3 == 0, values.parse_year(text)).alias("year"), F.when(i % 3 == 1, values.parse_int(text)).alias("int_value"), values.parse_track(F.concat(F.lit(" "), (i % 12000).cast("string"), F.lit("/12"))).alias("track"), values.parse_seconds(v.cast("string")).alias("seconds"), F.unix_micros(values.timestamp(iso)).alias("at"))


@query(r"""
SELECT event_id, CASE user_id % 4 WHEN 0 THEN (1 + user_id % 10)::VARCHAR WHEN 1 THEN (1 + user_id % 5)::VARCHAR WHEN 2 THEN '' ELSE '7' END AS energy,
       greatest(0, -(user_id - 8)) AS a, greatest(0, user_id - 8) AS b, greatest(0, least(20 - greatest(0, 8 - user_id), event_id % 30 - greatest(0, user_id - 8))) AS n FROM events""")
def energies_and_overlaps(spark, d):
    """NU03, NU07."""
    u = F.col("user_id")
    s = F.when(u % 4 == 0, F.concat(F.lit("warm / "), (1 + u % 10).cast("string"), F.lit(" ; 99"))).when(u % 4 == 1, F.expr("repeat('*', int(1 + user_id % 5))")).when(u % 4 == 2, "no 11 here").otherwise("8A, 77 - Energy 7")
    s = F.when(u % 4 == 3, "x, 77 - Energy 7").otherwise(s)
    o = values.overlap_bounds(F.lit(20), F.col("event_id") % 30, u - 8)
    return t(spark, d, "events").select("event_id", values.energy_from_text(s).alias("energy"), o["a"].alias("a"), o["b"].alias("b"), o["n"].alias("n"))


@query("""
SELECT p_partkey, upper(sha256(p_name)) AS content_hash, sha1(p_name || p_brand) AS text_hash, array_to_string(list_sort(list_distinct([lower(p_type), lower(p_brand), 'zz'])), ' | ') AS display,
       CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS genre, p_brand AS artist, '<present>' AS secret, '' AS blank, p_brand AS plain, '2' AS right_wins, p_size::VARCHAR AS left_stays FROM part""")
def maps_and_hashes(spark, d):
    """HB01, HB02, HB05, HB06, HB08, PF34, SK14."""
    p = t(spark, d, "part")
    first = F.create_map(F.lit(" Genre "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" "), F.lit("x"), F.lit(""))
    second = F.create_map(F.lit("genre"), F.col("p_type"), F.lit("ARTIST"), F.col("p_brand"))
    tags = values.merge_tags(first, second)
    hidden = values.redact(F.create_map(F.lit("client_secret"), F.col("p_name"), F.lit("Password"), F.lit(""), F.lit("user"), F.col("p_brand")))
    merged = F.from_json(values.merge_json(F.to_json(F.create_map(F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.lit("1"))), F.lit('{"b":"2"}')), "map<string,string>")
    names = F.array_distinct(F.array(F.lower("p_type"), F.lower("p_brand"), F.lit("zz")))
    return p.select("p_partkey", values.file_hash(F.encode("p_name", "UTF-8")).alias("content_hash"), values.text_hash(F.concat("p_name", "p_brand")).alias("text_hash"), tx.display_join(names).alias("display"), values.pick_tag(tags, ["none", "genre"]).alias("genre"), values.pick_tag(tags, ["artist"]).alias("artist"), hidden["client_secret"].alias("secret"), hidden["Password"].alias("blank"), hidden["user"].alias("plain"), merged["b"].alias("right_wins"), merged["a"].alias("left_stays"))


@query(r"""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), i AS (SELECT item_id, w, unnest(range(0, len(w) - 3, 8)) AS pos FROM w WHERE len(w) >= 4)
SELECT item_id, pos, array_to_string(w[pos + 1:pos + 4], ' ') AS shingle FROM i""")
def stepped_shingles(spark, d):
    """HB07: four words at every eighth place."""
    b = t(spark, d, "benchmark").select("item_id", F.explode(values.shingles(F.split("text", " "), 4, 8)).alias("s"))
    return b.select("item_id", F.col("s.pos").cast("long").alias("pos"), F.array_join("s.shingle", " ").alias("shingle"))


@query(rf"""
WITH q AS (SELECT *, CASE p_size % 5 WHEN 0 THEN 'flac' WHEN 1 THEN 'ape' WHEN 2 THEN 'mp3' WHEN 3 THEN 'pcm_s16be' ELSE 'alac' END AS codec, CASE WHEN p_size % 2 = 0 THEN 44100 ELSE 96000 END AS rate, CASE WHEN p_size % 3 = 0 THEN 24 ELSE 16 END AS bits FROM part)
SELECT p_partkey, CASE codec WHEN 'flac' THEN 5 WHEN 'alac' THEN 5 WHEN 'ape' THEN 4 ELSE 1 END * 1e6 + rate * 10.0 + bits * 1e3 + 320000 / 1e3 + p_partkey / 1e9 AS rank, rate = 44100 AND bits = 16 AND codec IN ('flac', 'alac', 'pcm_s16be') AS cd,
       CASE WHEN p_size % 3 = 0 THEN 'c' WHEN p_size % 3 = 1 THEN 'v' ELSE 'n' END AS advice,
       CASE WHEN p_size % 4 = 0 THEN 'blocked_duplicate_missing' WHEN p_size % 4 = 1 THEN 'blocked_keep_missing' WHEN p_size % 7 = 0 THEN 'blocked_duplicate_hash_changed' WHEN p_size % 5 = 0 THEN 'blocked_hash_mismatch' ELSE 'planned' END AS blocker,
       p_type = 'ECONOMY' AS excluded, {_alnum(_feat(rf"regexp_replace({_BARE}, '\b({WORDS})\b', ' ', 'g')"), "")} = {_alnum(_feat(rf"regexp_replace(regexp_replace(lower(p_name), '[\[(].*?[\])]', ' ', 'g'), '\b({WORDS})\b', ' ', 'g')"), "")} AS same_title FROM q""")
def audit_rules(spark, d):
    """PF03, PF06, PF08, PF10, PF14, PF22."""
    s = F.col("p_size")
    codec = F.element_at(F.array(*[F.lit(x) for x in ("flac", "ape", "mp3", "pcm_s16be", "alac")]), s % 5 + 1)
    rate, bits = F.when(s % 2 == 0, 44100).otherwise(96000), F.when(s % 3 == 0, 24).otherwise(16)
    kind = F.when(s % 3 == 0, "exact_file_duplicate").when(s % 3 == 1, "same_name_same_duration_candidate").otherwise("x")
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.CODEC_RANK.items() for x in kv]), codec)
    blocker = rules.exact_blocker(s % 4 != 0, s % 4 != 1, F.lit("ab"), F.when(s % 5 == 0, "cd").otherwise("AB"), F.when(s % 7 == 0, "ff").otherwise("Ab"))
    return t(spark, d, "part").select("p_partkey", rules.rank_score(rank, rate, bits, F.lit(320000), F.col("p_partkey")).alias("rank"), rules.cd_quality(codec, rate, bits).alias("cd"), F.lower(F.substring(rules.group_advice(kind), 1, 1)).alias("advice"), blocker.alias("blocker"), reports.excluded_genre(F.when(F.col("p_type") == "ECONOMY", " Tools  Samples").otherwise(F.col("p_type")), True).alias("excluded"), rules.titles_match(F.expr(TITLE), F.col("p_name"), "loose").alias("same_title"))


@query("""
WITH q AS (SELECT event_id, event_id % 2 = 0 AS has, ['high', 'medium', 'low', 'identity_only'][user_id % 4 + 1] AS label, event_id % 3 = 0 AS existing, event_id % 5 = 0 AS no_ok, event_id % 4 AS artists FROM events),
c AS (SELECT *, CASE WHEN has THEN label WHEN existing THEN 'medium' ELSE 'none' END AS conf, label IN ('low', 'identity_only') AS weak FROM q)
SELECT event_id, conf AS confidence_label, CASE WHEN (conf NOT IN ('high', 'medium') AND (no_ok OR artists > 2)) OR (has AND weak) OR (NOT has AND NOT existing) THEN 'manual_review' WHEN has THEN 'proposed' ELSE 'existing_tag_only' END AS decision_state,
       concat_ws('; ', CASE WHEN has AND weak THEN 'low confidence candidate' WHEN has THEN NULL WHEN existing THEN 'existing genre tag found but no external confirmation' ELSE 'no genre candidate' END,
                 CASE WHEN conf NOT IN ('high', 'medium') AND no_ok THEN 'no platform ok' END, CASE WHEN conf NOT IN ('high', 'medium') AND artists > 2 THEN 'multiple artists' END) AS review_reason,
       CASE WHEN event_id % 11 = 0 THEN 'skipped_locked' WHEN event_id % 7 = 0 THEN 'skipped_active_run' WHEN user_id = 0 THEN 'done' WHEN value > 100 THEN 'cooldown' WHEN event_id % 2 = 0 THEN 'dry_run' ELSE 'start' END AS retry FROM c JOIN events USING (event_id)""")
def decision_states(spark, d):
    """PF42, ST08."""
    i, u = F.col("event_id"), F.col("user_id")
    label = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "identity_only")]), (u % 4 + 1).cast("int"))
    p = rules.proposal(i % 2 == 0, label, i % 3 == 0, i % 5 == 0, i % 4)
    return t(spark, d, "events").select("event_id", p["confidence_label"].alias("confidence_label"), p["decision_state"].alias("decision_state"), p["review_reason"].alias("review_reason"), rules.retry_decision(i % 11 == 0, i % 7 == 0, u, F.col("value"), F.lit(100.0), i % 2 == 0).alias("retry"))


@query("""
WITH q AS (SELECT o_orderkey, ['move_file', 'rename_file', 'copy_file'][(o_orderkey % 3 + 1)::INT] AS op, o_orderkey % 5 = 0 AS folder, o_orderstatus = 'F' AS finished, o_orderkey % 7 = 0 AS same, o_orderkey % 4 = 0 AS wav, o_orderkey % 11 = 0 AS there FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN op = 'copy_file' THEN 'unsupported_type' END, CASE WHEN folder THEN 'target_is_not_a_file' END, CASE WHEN finished THEN 'not_pending' END, CASE WHEN same THEN 'same_path' END,
       CASE WHEN wav AND NOT same THEN 'destination_extension' END, CASE WHEN wav AND NOT same THEN 'extension_changes' END, CASE WHEN o_orderkey % 13 = 0 THEN 'source_outside_roots' END, CASE WHEN there THEN 'destination_exists' END) AS violations FROM q""")
def operation_checks(spark, d):
    """PF26."""
    o = F.col("o_orderkey")
    op = F.struct(F.element_at(F.array(F.lit("move_file"), F.lit("rename_file"), F.lit("copy_file")), (o % 3 + 1).cast("int")).alias("op_type"), F.when(o % 5 == 0, "folder").otherwise("file").alias("target_kind"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("file_action_status"))
    src = F.concat(F.lit("D:\\A\\"), o.cast("string"), F.lit(".flac"))
    dst = F.when(o % 7 == 0, F.concat(F.lit("d:/a/"), o.cast("string"), F.lit(".FLAC"))).otherwise(F.concat(F.lit("D:\\B\\"), o.cast("string"), F.when(o % 4 == 0, ".wav").otherwise(".flac")))
    v = rules.operation_violations(op, src, dst, [".flac"], F.when(o % 13 != 0, "D:\\A"), F.lit("D:\\B"), F.lit(True), o % 11 == 0)
    return t(spark, d, "orders").select("o_orderkey", F.array_join(v, ",").alias("violations"))


@query("""
WITH q AS (SELECT event_id, [128, 144, 176, 150, 182, 240][(event_id % 6 + 1)::INT] AS status, [11, 12, 4, 20, 23, 2][(event_id % 6 + 1)::INT] AS d1, user_id % 3 AS d2 FROM events)
SELECT event_id, CASE status WHEN 128 THEN 'note_off' WHEN 144 THEN 'note_on' WHEN 176 THEN 'control_change' WHEN 150 THEN 'note_on' WHEN 182 THEN 'control_change' ELSE 'system_or_unknown' END AS status_name,
       CASE WHEN status < 240 THEN status % 16 + 1 END AS channel, CASE WHEN status IN (128, 144, 176) THEN 'Deck A' WHEN status IN (150, 182) THEN 'Mixer' END AS control_group,
       CASE status WHEN 128 THEN 'PLAY/PAUSE' WHEN 144 THEN 'CUE' WHEN 176 THEN 'TEMPO slider' WHEN 182 THEN 'Crossfader' END AS control_name,
       CASE WHEN status = 128 THEN 'release' WHEN status = 144 THEN CASE WHEN d2 = 0 THEN 'release' ELSE 'press' END WHEN status IN (176, 182) THEN 'value' END AS action FROM q""")
def midi_meanings(spark, d):
    """PF28."""
    i = (F.col("event_id") % 6 + 1).cast("int")
    m = rules.midi(F.element_at(F.array(*[F.lit(x) for x in (128, 144, 176, 150, 182, 240)]), i), F.element_at(F.array(*[F.lit(x) for x in (11, 12, 4, 20, 23, 2)]), i), (F.col("user_id") % 3).cast("int"))
    return t(spark, d, "events").select("event_id", m.alias("m")).select("event_id", "m.*")


_LOOSE = _alnum(_feat(rf"regexp_replace({_BARE}, '\b({WORDS})\b', ' ', 'g')"), "")


@query(rf"""
WITH l AS (SELECT p_name, min(p_partkey) AS local_id, min(p_brand) AS artist, {_alnum(_feat("lower(p_name)"), "")} AS key FROM part GROUP BY p_name),
tok AS (SELECT p_partkey, {_alnum(_feat(f"lower({TITLE})"), "")} AS whole, {_LOOSE} AS loose, list_filter(list_distinct(string_split({_MATCH}, ' ')), lambda x: x NOT IN ('', 'and', 'the', 'feat', 'ft', 'featuring', 'vs', 'x')) AS r FROM part),
p AS (SELECT tok.p_partkey, local_id, whole = key AS same, len(list_intersect(r, string_split(trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')), ' '))) AS shared, len(r) AS n FROM tok JOIN l ON key IN (whole, loose)),
s AS (SELECT *, CASE WHEN same THEN 55 ELSE 45 END + CASE WHEN shared > 0 THEN least(35, 15 + 10 * shared) WHEN n = 0 THEN 5 ELSE 0 END AS score FROM p)
SELECT p_partkey, local_id, shared::BIGINT AS shared, score::BIGINT AS score, CASE WHEN score >= 70 THEN 'solid' WHEN score >= 55 THEN 'review' ELSE 'missing' END AS status FROM s""")
def token_score_match(spark, d):
    """NU09, TX08, SO08, PF11, SI08: titles against a catalogue of one row a name, by title keys and shared artist tokens.

    The catalogue has one row a key, so a popular title multiplies nothing.
    """
    p = t(spark, d, "part")
    local = p.groupBy("p_name").agg(F.min("p_partkey").alias("local_id"), F.min("p_brand").alias("artist")).select(tx.compact_key(F.col("p_name")).alias("key"), "local_id", tx.artist_tokens(F.col("artist")).alias("own"))
    s, a = F.expr(TITLE), F.expr(ARTIST)
    wanted = p.select("p_partkey", tx.compact_key(s).alias("whole"), tx.loose_title_key(s, master=False).alias("loose"), tx.artist_tokens(a).alias("r"))
    pairs = wanted.withColumn("key", F.explode(F.array_distinct(F.array("whole", "loose")))).join(local, "key")
    shared = F.size(F.array_intersect("r", "own"))
    score = values.match_score(F.col("key") == F.col("whole"), F.col("key") == F.col("loose"), F.lit(False), shared, F.size("r"))
    return pairs.select("p_partkey", "local_id", shared.cast("long").alias("shared"), score.cast("long").alias("score"), values.match_status(score).alias("status"))
