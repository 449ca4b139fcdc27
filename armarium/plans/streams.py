"""Streaming queries bound to the given tables; each equals its batch twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as dd
from ..session import work_path
from ..streaming import jobs as j
from . import views as v
from .duplicates import FPS, _KEPT
from .landing import CHANGE_SQL, change_feed_rows, known_users
from .matching import TWO_RUNS_SQL


def arrivals(df, path: str, parts: list):
    """Write the rows of each condition in turn; the caller runs its job after each."""
    for p in parts:
        df.where(p).write.mode("append").parquet(path)
        yield


#: Middle of the month, five days and less before it, and the last days.
REPLAY_CUTS = ["2024-01-16", "2024-01-12", "2024-01-28"]


def events_path(d):
    return f"{d}/events*.parquet"


def schema_of(spark, d, name):
    return v.table(spark, d, name).schema


def cursor_ingest(spark, d):
    sink, ckpt = work_path(spark, "ingest"), work_path(spark, "ckpt")
    j.ingest(spark, events_path(d), schema_of(spark, d, "events"), sink, ckpt, F.col("event_type") != "error")
    j.ingest(spark, events_path(d), schema_of(spark, d, "events"), sink, ckpt, F.col("event_type") != "error")  # nothing new: no rows twice
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("cursor"))


def replay_dedup(spark, d):
    """Events arriving over two transports: every id is stored once."""
    one = j.file_stream(spark, events_path(d), schema_of(spark, d, "events")).select("event_id", "ts", "event_type")
    two = j.file_stream(spark, events_path(d), schema_of(spark, d, "events")).where("event_id % 2 = 0").select("event_id", "ts", "event_type")
    sink = work_path(spark, "unique")
    j.drain(j.unique_events(one.union(two), ["event_id"], "ts", "40 days"), work_path(spark, "ckpt"), sink=sink)
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


def keyed_updates(spark, d):
    """Events whose value changes in replays: first those of the first half of the month, then the rest with a
    newer version of some recent ones, then versions of recent ones and of some that are too late."""
    e = v.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    mid, recent, last = (F.lit(x).cast("timestamp") for x in REPLAY_CUTS)
    first = e.where(F.col("ts") < mid).withColumn("version", F.lit(1))
    second = e.where(F.col("ts") >= mid).withColumn("version", F.lit(1)).unionByName(
        e.where((F.col("ts") >= recent) & (F.col("ts") < mid) & (F.col("event_id") % 3 == 0)).withColumns({"value": F.col("value") + 100, "version": F.lit(3)}))
    third = e.where((F.col("ts") >= last) & (F.col("event_id") % 2 == 0)).withColumns({"value": F.col("value") + 50, "version": F.lit(2)}).unionByName(
        e.where((F.col("ts") < recent) & (F.col("event_id") % 2 == 0)).withColumns({"value": F.lit(-1.0), "version": F.lit(9)}))
    path, ckpt = work_path(spark, "replays"), work_path(spark, "ckpt")
    log = j.BatchLog(spark, work_path(spark, "events"), "event_id bigint, ts timestamp, version int, value double")
    for part in (first, second, third):
        part.write.mode("append").parquet(path)
        out = j.keyed_updates(j.file_stream(spark, path, part.schema), "event_id", "ts", "version", ["value"], "5 days", log, ckpt)
    return out.select("event_id", "version", "value")


def near_duplicates(spark, d):
    """Documents in two arrivals; the second meets the kept fingerprints of the first."""
    texts = v.texts(spark, d).select(F.col("doc_id").alias("item"), "text", F.lit("2024-01-20").cast("timestamp").alias("created_at"))
    middle = texts.agg((F.max("item") / 2).alias("m")).scalar()
    path, ckpt = work_path(spark, "texts"), work_path(spark, "ckpt")
    kept, found = j.BatchLog(spark, work_path(spark, "kept"), j.KEPT, ["day"]), j.BatchLog(spark, work_path(spark, "found"), j.FOUND)
    for _ in arrivals(texts.withColumn("first", F.col("item") < middle), path, [F.col("first"), ~F.col("first")]):
        j.near_duplicate_stream(j.file_stream(spark, path, texts.withColumn("first", F.lit(True)).schema), kept, found, ckpt)
    return found.read().select("item", "original")


def match_alerts(spark, d):
    """Offers in two arrivals against standing wants."""
    wants, o = v.market(spark, d)
    early = F.col("posted_at") < F.lit("1998-01-01").cast("timestamp")
    path, ckpt = work_path(spark, "offers"), work_path(spark, "ckpt")
    alerts = j.BatchLog(spark, work_path(spark, "alerts"), j.ALERTS)
    for _ in arrivals(o, path, [early, ~early]):
        j.match_alert_stream(j.file_stream(spark, path, o.schema), wants, alerts, ckpt)
    return alerts.read().select("spec_id", "offer_id", "score")


def weekly_flow(spark, d):
    stream = j.windowed_flow(j.file_stream(spark, events_path(d), schema_of(spark, d, "events")), "ts", "7 days", "1 day", "event_type", start="4 days")
    log = j.BatchLog(spark, work_path(spark, "flow"), "window_start timestamp, event_type string, n bigint")
    out = j.upsert_windows(stream, log, work_path(spark, "ckpt"), ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def change_stream(spark, d):
    rows, at = change_feed_rows(spark, d), F.col("updated_at")
    path, ckpt = work_path(spark, "changes"), work_path(spark, "ckpt")
    pos = rows.schema["pos"].dataType.simpleString()
    log = j.BatchLog(spark, work_path(spark, "touched"), f"key bigint, new_name string, last_up {pos}, last_gone {pos}, first_known {pos}, new_at {rows.schema['updated_at'].dataType.simpleString()}")
    for _ in arrivals(rows, path, [at < "2024-01-10", (at >= "2024-01-10") & (at < "2024-01-20"), at >= "2024-01-20"]):
        out = j.apply_change_stream(j.file_stream(spark, path, rows.schema), known_users(spark, d), log, ckpt)
    return out


QUERIES = {
    "ts1_cursor_ingest": cursor_ingest, "ts2_replay_dedup": replay_dedup, "ts2_keyed_updates": keyed_updates, "ts3_near_duplicates": near_duplicates, "ts4_match_alerts": match_alerts,
    "ts5_weekly_flow": weekly_flow, "ts6_change_stream": change_stream,
}
ORACLE = {
    "ts1_cursor_ingest": "SELECT event_type, count(*) n, max(event_id) AS \"cursor\" FROM events WHERE event_type <> 'error' GROUP BY 1",
    "ts2_replay_dedup": "SELECT event_type, count(*) n, count(*) n_ids FROM events GROUP BY 1",
    "ts2_keyed_updates": """SELECT event_id, CASE WHEN ts >= TIMESTAMP '{0}' AND ts < TIMESTAMP '{1}' AND event_id % 3 = 0 THEN 3 WHEN ts >= TIMESTAMP '{2}' AND event_id % 2 = 0 THEN 2 ELSE 1 END AS "version",
        value + CASE WHEN ts >= TIMESTAMP '{0}' AND ts < TIMESTAMP '{1}' AND event_id % 3 = 0 THEN 100 WHEN ts >= TIMESTAMP '{2}' AND event_id % 2 = 0 THEN 50 ELSE 0 END AS value FROM events""".format(REPLAY_CUTS[1], REPLAY_CUTS[0], REPLAY_CUTS[2]),
    "ts3_near_duplicates": f"""WITH {FPS}, kept AS (SELECT unnest({_KEPT}, recursive := true) FROM fp)
        SELECT f.doc_id item, min(k.id) original FROM fp f JOIN kept k ON k.id < f.doc_id AND bit_count(xor(f.fp, k.fp)) <= 8 GROUP BY 1""",
    "ts4_match_alerts": TWO_RUNS_SQL + " SELECT spec_id, offer_id, score FROM best0 UNION SELECT spec_id, offer_id, score FROM best",
    "ts5_weekly_flow": """SELECT date_trunc('week', ts)::TIMESTAMP window_start, event_type, count(*) n FROM events GROUP BY 1, 2""",
    "ts6_change_stream": CHANGE_SQL,
}
