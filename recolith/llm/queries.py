"""Registered queries of this subpackage, and their SQL oracles.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.near_vectors import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.near_text import near_text_classes

    return near_text_classes(_read(spark, sf_dir, "documents"), k=4, least_pct=80)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.language_id import identify_languages

    return identify_languages(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.quality import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.lm_score import lm_scores

    return lm_scores(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.secrets import find_secrets

    return find_secrets(_read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.mixing import mix_copies

    out = mix_copies(_read(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recolith.llm.token_ids import token_ids

    return token_ids(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from recolith.llm.nearest import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.merkle import merkle_manifest

    return merkle_manifest(_read(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recolith.llm.resample import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_mix_sources": op7_mix_sources,
    "op8_near_vectors": op8_near_vectors,
    "op9_near_text": op9_near_text,
    "op10_token_ids": op10_token_ids,
    "op11_nearest": op11_nearest,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_resample": op13_resample,
}

_MIX = r"""
WITH d AS (
  SELECT doc_id, text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) AS rnk FROM d GROUP BY skey),
w AS (
  SELECT *, (CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w, 3 * source_size AS cap FROM s),
p AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0))::DOUBLE AS lvl
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT lvl AS final FROM p WHERE lvl * w <= cap::DOUBLE ORDER BY cap::DOUBLE / w, skey LIMIT 1),
t AS (
  SELECT skey, source_size, coalesce(least(cap::DOUBLE, (SELECT final FROM f) * w), cap::DOUBLE) AS target,
         ('0x' || substr(md5('17:' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM p),
r AS (
  SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.skey ORDER BY d.size DESC, d.doc_id)::DOUBLE AS k
  FROM d JOIN t ON d.skey = t.skey)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE least(floor(target / source_size::DOUBLE * k + u) - floor(target / source_size::DOUBLE * (k - 1) + u), 3) END::BIGINT * size AS taken
FROM r
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n),
k AS (SELECT n, min(c) AS component_id FROM r GROUP BY 1), l AS (SELECT a, count(*) AS n_links FROM p GROUP BY 1)
SELECT k.n AS vec_id, coalesce(l.n_links, 0) AS n_links, k.component_id, k.n = k.component_id AS kept FROM k LEFT JOIN l ON l.a = k.n
"""

_TEXTS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
z AS (SELECT doc_id, len(s) AS n FROM s), f AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(n, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
k AS (SELECT n, min(c) AS component_id FROM r GROUP BY 1)
SELECT k.n AS doc_id, z.n AS n_shingles, k.component_id, k.n = k.component_id AS kept FROM k JOIN z ON z.doc_id = k.n
"""

# DuckDB has no CRC; a table of 256 entries from the polynomial, then one step a byte.
_CRC = r"""
crc(t) AS (SELECT list(list_reduce([i::UBIGINT] || [x::UBIGINT for x in range(8)], lambda a, x: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """SQL for the CRC of a text, over the table ``crc``."""
    codes = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::UBIGINT)"
    return f"xor(list_reduce([4294967295::UBIGINT] || {codes}, lambda a, x: xor(t[(xor(a, x) & 255)::INT + 1], a >> 8)), 4294967295::UBIGINT)"


_field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

_MERKLE = f"""
WITH RECURSIVE {_CRC.strip()},
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS sk,
             sha256(concat({", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))})) AS leaf,
             coalesce({_crc("doc_id::VARCHAR")} % 2 = 0, false) AS hit,
             sha256(concat({", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))}, {_field("replace(text, chr(10), '')")})) AS other
      FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
s(lvl, sk, pos, node, n) AS (
  SELECT 0, sk, p, leaf, count(*) OVER (PARTITION BY sk) FROM r UNION ALL
  SELECT lvl + 1, sk, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM s WHERE n > 1 GROUP BY lvl, sk, pos // 3),
h AS (SELECT sk, lvl AS height, node AS subroot FROM s WHERE n = 1),
u(lvl, pos, node, n) AS (
  SELECT 0, row_number() OVER (ORDER BY sk) - 1, subroot, count(*) OVER () FROM h UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3),
k AS (SELECT *, row_number() OVER (ORDER BY sk) - 1 AS at FROM h),
a AS (SELECT lvl, sk, pos, node, n FROM s WHERE n > 1 UNION ALL
      SELECT u.lvl + 1000, NULL, u.pos, u.node, u.n FROM u WHERE u.n > 1),
sib AS (
  SELECT x.lvl, x.sk, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lft, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS rgt
  FROM a x JOIN a y ON x.lvl = y.lvl AND x.sk IS NOT DISTINCT FROM y.sk AND x.pos // 3 = y.pos // 3 GROUP BY 1, 2, 3),
path AS (
  SELECT r.sk, r.p, sib.lvl, lft, rgt FROM r JOIN sib ON sib.sk = r.sk AND sib.pos = r.p // (3 ** sib.lvl)::BIGINT UNION ALL
  SELECT r.sk, r.p, sib.lvl, lft, rgt FROM r JOIN k ON k.sk = r.sk JOIN sib ON sib.sk IS NULL AND sib.pos = k.at // (3 ** (sib.lvl - 1000))::BIGINT),
g AS (SELECT sk, p, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof, list({{'l': lft, 'r': rgt}} ORDER BY lvl) AS steps FROM path GROUP BY 1, 2),
f(sk, p, i, hash) AS (
  SELECT sk, p, 0, CASE WHEN hit THEN other ELSE leaf END FROM r UNION ALL
  SELECT f.sk, f.p, i + 1, sha256(g.steps[i + 1].l || hash || g.steps[i + 1].r) FROM f JOIN g ON g.sk = f.sk AND g.p = f.p WHERE i < len(g.steps)),
e AS (SELECT sk, p, arg_max(hash, i) AS folded FROM f GROUP BY 1, 2)
SELECT r.doc_id, r.leaf, h.subroot, (SELECT node FROM u WHERE n = 1) AS root, coalesce(g.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = (SELECT node FROM u WHERE n = 1) AS verified
FROM r JOIN h ON h.sk = r.sk JOIN e ON e.sk = r.sk AND e.p = r.p LEFT JOIN g ON g.sk = r.sk AND g.p = r.p
"""

_RESAMPLE = rf"""
WITH {_CRC.strip()},
w AS (SELECT kind, id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
      FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
f AS (SELECT kind, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
v AS (SELECT g, {_crc("g")} % 10000 AS b FROM (SELECT DISTINCT g FROM f), crc),
x AS (SELECT f.kind, f.rid, v.b, count(*) AS n FROM f JOIN v ON v.g = f.g GROUP BY 1, 2, 3),
c AS (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM x GROUP BY 1),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
gain AS (SELECT b, floor(1000 * ln((c.t + 1) * (z.s + 10000) / ((c.s + 1) * (z.t + 10000))))::BIGINT AS gain FROM c, z),
m AS (SELECT rid, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM x JOIN gain ON gain.b = x.b WHERE kind = 0 GROUP BY 1),
o AS (SELECT w.id AS doc_id, len(w.w) >= 20 AS ok, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
             coalesce(m.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m ON m.rid = w.rid WHERE kind = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY ok) AS k FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND r <= 25 * k // 100 THEN r END AS rank FROM q
"""

ORACLE_SQL: dict[str, str] = {
    "op12_merkle_manifest": _MERKLE,
    "op13_resample": _RESAMPLE,
    "op7_mix_sources": _MIX,
    "op8_near_vectors": _VECTORS,
    "op9_near_text": _TEXTS,
}
