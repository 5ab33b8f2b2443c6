"""Registered queries over capture files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolith.plans.catalog import query, t
from recolith.scratch import new_path
from recolith.streaming import bridge, capture


def _little(c, n: int):
    """A number as ``n`` bytes, lowest first, in hex."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])


def _captures(spark, d) -> str:
    """A folder of capture files: a packet a document, 2,000 ids a file, no to three events a packet."""
    x = t(spark, d, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("n")).withColumn("k", (F.col("doc_id") % 4).cast("int"))
    event = lambda i: F.concat(F.lit("09"), F.lpad(F.hex(F.lit(0x90) + F.lit(i)), 2, "0"), F.lpad(F.hex(F.col("doc_id") % 128), 2, "0"), F.lpad(F.hex(F.col("n") % 128), 2, "0"))
    head = F.concat(F.lit("1B00"), F.lit("00" * 15), _little(F.col("doc_id") % 3, 2), _little(F.col("doc_id") % 5, 2), F.lit("8503"), _little(F.col("k") * 4, 4))
    body = F.concat(*[F.when(F.col("k") > i, event(i)).otherwise("") for i in range(3)])
    packets = x.select(F.format_string("f%d.pcap", F.floor(F.col("doc_id") / 2000)).alias("file"), F.col("doc_id").alias("seq"), (1700000000 + F.col("doc_id")).alias("seconds"), (F.col("n") % 1000000).alias("micros"), F.unhex(F.concat(head, body)).alias("payload"))
    folder = new_path(spark, "captures")
    capture.write_captures(packets, folder).write.format("noop").mode("overwrite").save()
    spark.dataSource.register(capture.CaptureSource)
    return folder


_PACKETS = """
WITH p AS (SELECT doc_id, max(n_chars) AS n, doc_id % 4 AS k, 'f' || (doc_id // 2000)::VARCHAR || '.pcap' AS file, (1700000000 + doc_id)::DOUBLE + (max(n_chars) % 1000000)::DOUBLE / 1000000 AS ts FROM documents GROUP BY doc_id),
q AS (SELECT *, 24 + coalesce(sum(43 + 4 * k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS packet_at, first_value(ts) OVER w AS zero FROM p WINDOW w AS (PARTITION BY file ORDER BY doc_id)),
e AS (SELECT *, unnest(range(0, k)) AS i FROM q),
m AS (SELECT file, packet_at, ts, ts - zero AS relative_seconds, (doc_id % 3)::INT AS bus, (doc_id % 5)::INT AS device, (4 * i)::INT AS payload_offset,
             '9' || i::VARCHAR || printf('%02X', doc_id % 128) || printf('%02X', n % 128) AS midi_hex FROM e)"""


@query(f"{_PACKETS} SELECT * FROM m")
def capture_events(spark, d):
    """ST01, SC51, SC52, SC53, WN15: captures read in ranges of 32 KB, cut anywhere."""
    df = spark.read.format("usb_capture").option("splitBytes", 32 << 10).load(_captures(spark, d))
    return df.select(F.element_at(F.split("file", "/"), -1).alias("file"), "packet_at", "ts", "relative_seconds", "bus", "device", "payload_offset", F.hex("midi").alias("midi_hex"))


@query(f"""
{_PACKETS}, d AS (SELECT bus, device, count(*) AS n FROM m GROUP BY 1, 2)
SELECT count(*) AS sent, count(DISTINCT (file, packet_at)) AS packets, min_by(midi_hex, (ts, packet_at, payload_offset)) AS first_midi_hex, max_by(midi_hex, (ts, packet_at, payload_offset)) AS last_midi_hex,
       (SELECT string_agg(bus || '/' || device || '/133:' || n, ';' ORDER BY n DESC, bus, device) FROM (SELECT * FROM d ORDER BY n DESC, bus, device LIMIT 12)) AS top_endpoints,
       (SELECT string_agg(bus || '/' || device || ':' || n, ';' ORDER BY n DESC, bus, device) FROM (SELECT * FROM d ORDER BY n DESC, bus, device LIMIT 8)) AS top_devices FROM m""")
def capture_summary(spark, d):
    """ST03, AG18: what a bridge reports of all events of an endpoint."""
    df = bridge.filtered(spark.read.format("usb_capture").load(_captures(spark, d)), 0x85)
    said = lambda c, names: F.array_join(F.transform(c, lambda x: F.concat(F.concat_ws("/", *[x[n].cast("string") for n in names]), F.lit(":"), x["n"].cast("string"))), ";")
    s = bridge.bridge_summary(df)
    return s.select("sent", "packets", "first_midi_hex", "last_midi_hex", said(F.col("top_endpoints"), ["bus", "device", "endpoint"]).alias("top_endpoints"), said(F.col("top_devices"), ["bus", "device"]).alias("top_devices"))
