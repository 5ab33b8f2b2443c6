"""Text tables, logs, exports and their writers (SC13-SC26, SC28, SC30-SC34, SC36, SC37, SC39, SC40, SK01-SK07, SK10, SK12, SK13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recolith.operators.ranks import positions
from recolith.sources.xml_tags import tag_attributes, tags

EVENT = "ts string, action string, status struct<platform:string,progress:double,status:struct<path:string,status:string,message:string,accuracy:double,usedShazam:boolean>>"
EXPORT = "playlists array<struct<name:string,id:long,rows:int,first:long,local_rows:int,streaming_rows_ignored:int,missing_content_rows:int,entries:array<struct<content_id:long,title:string,artist:string,folder_path:string,track_no:int>>>>"


def csv(spark: SparkSession, path: str) -> DataFrame:
    """SC13: header, any byte order mark dropped, all strings."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def typed_report(df: DataFrame, **numbers: float | None) -> DataFrame:
    """SC14: named columns as doubles with a default."""
    for c, default in numbers.items():
        x = F.col(c).try_cast("double")
        df = df.withColumn(f"{c}_num", x if default is None else F.coalesce(x, F.lit(default)))
    return df


def delete_pairs(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """SC15, SC16: rows of a duplicate report that may go, hashes in upper case."""
    return df.where((F.lower("action") == "delete_candidate") & F.col("match_kind").isin(*kinds)).withColumn("sha256", F.upper("sha256"))


def redirects(df: DataFrame, loser: str, keeper: str, ordinal: str) -> DataFrame:
    """SC17: loser to keeper, the last row wins."""
    return df.groupBy(F.col(loser).alias("loser")).agg(F.max_by(keeper, ordinal).alias("keeper"))


def recommendations(df: DataFrame) -> DataFrame:
    """SC18."""
    from recolith.functions.text import as_bool, confidence, spaced

    texts = [c for c in df.columns if c not in ("confidence", "review_required")]
    return df.select(*[spaced(F.coalesce(c, F.lit(""))).alias(c) for c in texts], confidence("confidence").alias("confidence"), as_bool("review_required").cast("string").alias("review_required"))


def m3u(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """SC19, SC20: paths of a playlist file, without comments and blanks."""
    df = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("path")).where("path <> '' AND NOT startswith(path, '#')")
    return df.distinct() if distinct else df


def _place() -> Column:
    """Order of rows read: by file, by place of the split in it, by row of the split, however splits are dealt."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))


def cache(spark: SparkSession, path: str, schema_tag: str | None, key: Sequence[str], schema: str) -> DataFrame:
    """SC21, SC22: a JSON lines cache; malformed lines go, ok rows of the schema stay, the last of a key wins."""
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED").withColumn("__o", _place())
    if schema_tag is not None:
        df = df.where((F.col("schema") == schema_tag) & (F.col("status") == "ok"))
    rest = [c for c in df.columns if c not in (*key, "__o")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "__o").alias("r")).select(*key, "r.*")


def event_log(spark: SparkSession, *paths: str) -> DataFrame:
    """SC23, SC24: tagging events of one or many logs, with an order within a file.

    ``ordinal`` is a row's place: its file, the start of its split and its
    number there.
    """
    df = spark.read.schema(EVENT).json(list(paths), mode="DROPMALFORMED").withColumn("ordinal", _place())
    ev = df.where((F.col("action") == "taggingProgress") & F.col("status.platform").isNotNull() & F.col("status.status.path").isNotNull())
    return ev.select("ts", F.col("status.platform").alias("platform"), F.col("status.status.path").alias("path"), F.lower("status.status.path").alias("path_key"), F.col("status.status.status").alias("status"), F.col("status.status.message").alias("message"), F.col("status.status.accuracy").alias("accuracy"), F.col("status.status.usedShazam").alias("used_shazam"), "ordinal")


def playlist_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SC25: one row an entry.

    An export is one document over many lines; ``lines`` reads one of
    ``write_playlists``, whose pieces go on where those before them end.
    """
    df = spark.read.schema(EXPORT).json(path, multiLine=not lines).select(F.explode("playlists").alias("p"))
    df = df.select("p.name", "p.id", F.coalesce("p.first", F.lit(0)).alias("first"), F.posexplode_outer("p.entries").alias("pos", "e"))
    return df.select("name", "id", (F.col("first") + F.col("pos")).alias("pos"), "e.*")


def write_playlists(lists: DataFrame, entries: DataFrame, path: str, key: str, order: Sequence[Column], piece: int = 1000) -> None:
    """SK04: playlists as documents of an export, a line each, with at most ``piece`` entries.

    ``lists`` has ``key``, ``name`` and ``id``; ``entries`` has ``key`` and the
    fields of an entry, in their order. Lists of one key share its entries,
    which are numbered and put into pieces before they meet the lists, so no
    row holds more than a piece. A list without entries is written empty.
    """
    fields = F.struct(*[c for c in entries.columns if c != key])
    numbered = positions(entries.withColumn("__e", fields), [key], order, "__pos", "rows")
    pieces = numbered.groupBy(key, "rows", (F.col("__pos") - F.col("__pos") % piece).alias("first")).agg(F.array_sort(F.collect_list(F.struct("__pos", "__e"))).alias("x"))
    pieces = pieces.select(key, "rows", "first", F.transform("x", lambda e: e["__e"]).alias("entries"))
    out = lists.join(pieces, key, "left").select(F.array(F.struct("name", "id", F.coalesce("rows", F.lit(0)).alias("rows"), "first", F.coalesce("entries", F.expr("array()")).alias("entries"))).alias("playlists"))
    # Pieces repeat for lists that share entries.
    out.write.mode("overwrite").option("compression", "gzip").json(path)


def playlist_nodes(spark: SparkSession, path: str) -> DataFrame:
    """SC26: ``NODE`` tags at any depth of files of any size; tags without ``Id`` are skipped."""
    names = {"node_id": "Id", "parent_id": "ParentId", "attribute": "Attribute", "timestamp_raw": "Timestamp", "lib_type": "Lib_Type", "check_type": "CheckType"}
    return tag_attributes(tags(spark, path, "NODE"), names).where("node_id is not null").select(*names)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """SC28."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def operations(df: DataFrame, status: str | None = None, op_type: str | None = None, limit: int = 50) -> DataFrame:
    """SC30, SC31: recent operations with their payload decoded; the limit is the feature."""
    if status:
        df = df.where(F.col("status") == status)
    if op_type:
        df = df.where(F.col("op_type") == op_type)
    df = df.withColumn("payload", F.from_json("payload_json", "map<string,string>"))
    return df.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    """SC32: rows of each table that exists."""
    out = None
    for n, df in tables.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def existing(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """JN25, SC32: tables or views that a name stands for: whether each is there, and its rows; null where it is not.

    Names are configuration, a handful.
    """
    there = {k: spark.catalog.tableExists(v) for k, v in names.items()}
    known = spark.createDataFrame(list(there.items()), "table string, there boolean")
    found = {k: spark.table(names[k]) for k, ok in there.items() if ok}
    counts = table_status(found) if found else spark.createDataFrame([], "table string, n_rows long")
    return known.join(counts, "table", "left")


def key_lookup(keys: DataFrame, row_id: str, name: str, variants: Column) -> DataFrame:
    """SC33, SC34: names and their variants to ids; an id's own name beats another's variant."""
    flat = keys.select(row_id, F.posexplode(F.concat(F.array(F.lower(name)), variants)).alias("rank", "variant"))
    return flat.groupBy("variant").agg(F.min_by(row_id, F.struct("rank", row_id)).alias(row_id))


def remote_tracks(items: DataFrame, json: str, schema: str) -> DataFrame:
    """SC36: tracks of an item column; the first artist stands in for a missing one."""
    t = items.withColumn("t", F.from_json(json, schema)).where("t.id IS NOT NULL AND coalesce(t.type, 'track') = 'track'")
    return t.withColumn("artist", F.coalesce("t.artist.name", F.get("t.artists", F.lit(0))["name"], F.lit("")))


def query_variants(artist: Column, title: Column, clean: Column) -> Column:
    """SC39: search texts of an item, each once, in order."""
    q = lambda *c: F.trim(F.concat_ws(" ", *c))
    first = F.trim(F.split(artist, r"(?i)\s*(?:,|&|\+|\bfeat\.?\b|\bft\.?\b)\s*")[0])
    return F.filter(F.array_distinct(F.array(q(artist, title), q(artist, clean), q(first, title), q(first, clean), q(clean))), lambda x: x != "")


def fetch_candidates(wanted: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """SC37, SC40, SC47, ST10: what the cache has, and what must be fetched."""
    return wanted.join(cached, key), wanted.join(cached.select(key), key, "left_anti")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """SK01, SK02: fixed columns; arrays are joined, other nested cells are JSON. Files follow the order of the rows, each with a header."""
    df = df.select(*columns) if columns else df
    cells = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        cells.append((F.array_join(c.cast("array<string>"), ";") if t == "array" else F.to_json(c) if t in ("struct", "map", "variant") else c).alias(f.name))
    df.select(*cells).write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """SK03, SK04, SK12, SK13."""
    df.write.mode("append" if append else "overwrite").json(path)


def m3u_lines(df: DataFrame, path: str, order: Sequence[Column]) -> DataFrame:
    """SK05, SK06: header and paths as numbered lines."""
    body = positions(df, [], order).select((F.col("pos") + 1).alias("n"), F.col(path).alias("value"))
    return df.sparkSession.createDataFrame([(0, "#EXTM3U")], "n long, value string").unionByName(body).orderBy("n")


def playlist_files(memberships: DataFrame, playlist: str, path: str, order: str) -> DataFrame:
    """SK07: text of each playlist's file, and a name without forbidden characters.

    A playlist is one file, so its lines meet in one row; playlists do not
    grow with the library.
    """
    safe = F.regexp_replace(playlist, r'[<>:"/\\|?*]', "_")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, path))), lambda x: x[path])
    return memberships.groupBy(playlist).agg(lines.alias("l")).select(playlist, F.concat(safe, F.lit(".m3u8")).alias("file_name"), F.concat(F.lit("#EXTM3U\n"), F.array_join("l", "\n"), F.lit("\n")).alias("body"))


def report_path(root: str, name: str, stamp: str, ext: str) -> str:
    """SK10."""
    return f"{root.rstrip('/')}/{name}-{stamp}.{ext}"
