"""Streams that stop and start again over one checkpoint."""
import shutil
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armarium.operators import match, merge
from armarium.plans import views as v
from armarium.streaming import jobs as j


def arrivals(df, path, parts):
    for i, p in enumerate(parts):
        df.where(p).coalesce(1).write.parquet(f"{path}/arrival{i}")


def test_alerts_after_a_restart(spark, sf, tmp_path):
    """Two runs, the second with objects of its own, give what one run gives; only what enters the best of the
    whole market is an alert."""
    offers = v.offers(spark, sf)
    wants = v.wants(spark, sf).where("want_id % 20 = 0")
    early = F.col("posted_at") < F.lit("1998-01-01").cast("timestamp")
    arrivals(offers, str(tmp_path / "all"), [early, ~early])
    (tmp_path / "landing").mkdir()

    def run(k):
        stream = j.file_stream(spark, str(tmp_path / "landing" / "*"), offers.schema, 1)
        return {tuple(r) for r in j.match_alert_stream(stream, wants, j.BatchLog(spark, str(tmp_path / "alerts"), j.ALERTS), str(tmp_path / "ckpt"), k).select("spec_id", "offer_id").collect()}

    k = 5
    first = {tuple(r) for r in match.match_wants(wants, offers.where(early), k).select("spec_id", "offer_id").collect()}
    both = {tuple(r) for r in match.match_wants(wants, offers, k).select("spec_id", "offer_id").collect()}
    shutil.copytree(tmp_path / "all" / "arrival0", tmp_path / "landing" / "arrival0")
    assert run(k) == first
    shutil.copytree(tmp_path / "all" / "arrival1", tmp_path / "landing" / "arrival1")
    assert run(k) == first | both
    assert run(k) == first | both


def test_batch_log(spark, tmp_path):
    log = j.BatchLog(spark, str(tmp_path / "t"), "a bigint, b string, c string", ["c"])
    assert log.read().collect() == [] and log.read(before=3).collect() == []
    log.put(spark.createDataFrame([(1, "x", "k"), (2, "y", "k")], "a bigint, b string, c string"), 0)
    again = j.BatchLog(spark, str(tmp_path / "t"), "a bigint, b string, c string", ["c"])
    again.put(spark.createDataFrame([("k", "z", 2)], "c string, b string, a bigint"), 1)
    again.put(spark.createDataFrame([("k", "w", 2)], "c string, b string, a bigint"), 1)  # a replayed batch
    assert sorted(r["b"] for r in again.read().collect()) == ["w", "x", "y"] and sorted(r["b"] for r in again.read(before=1).collect()) == ["x", "y"]
    assert sorted((r["a"], r["b"]) for r in again.newest(["a"]).collect()) == [(1, "x"), (2, "w")]


def test_change_stream_writes_what_a_batch_touches(spark, tmp_path):
    """Restarts over one checkpoint give what the whole feed gives; a batch writes its own keys only."""
    schema = "key bigint, pos bigint, kind string, name string, updated_at timestamp"
    state = spark.range(1000).select(F.col("id").alias("key"), F.lit("given").alias("name"), F.lit(False).alias("deleted"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    feeds = [[(1, 1, "upsert", "a", None), (2, 2, "delete", None, None), (2000, 3, "placeholder", None, None)], [(1, 4, "delete", None, None), (3000, 5, "delete", None, None)],
             [(2, 6, "upsert", "b", None), (3000, 7, "upsert", "c", None), (2000, 8, "delete", None, None)]]
    log = j.BatchLog(spark, str(tmp_path / "log"), "key bigint, new_name string, last_up bigint, last_gone bigint, first_known bigint, new_at timestamp")
    frames = [spark.createDataFrame(f, schema) for f in feeds]
    for i in range(3):
        frames[i].write.mode("append").parquet(str(tmp_path / "in"))
        got = j.apply_change_stream(j.file_stream(spark, str(tmp_path / "in"), frames[0].schema), state, log, str(tmp_path / "ckpt")).collect()
        want = merge.apply_changes(state, reduce(DataFrame.unionByName, frames[:i + 1])).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert [r["count"] for r in log.read().groupBy("batch").count().orderBy("batch").collect() if r["count"]] == [3, 2, 3]


def test_near_duplicates_age_out(spark, tmp_path):
    """A copy inside 30 days is a duplicate of the kept text; after that it is kept and counts itself. Days that
    have aged out are not read: their files may be gone."""
    text = " ".join(f"word{i}" for i in range(40))
    kept, found = j.BatchLog(spark, str(tmp_path / "kept"), j.KEPT, ["day"]), j.BatchLog(spark, str(tmp_path / "found"), j.FOUND)
    for item, day in ((1, "2024-01-01"), (2, "2024-01-31"), (3, "2024-02-01"), (4, "2024-02-20")):
        df = spark.createDataFrame([(item, text), (item + 100, "short")], "item bigint, text string").withColumn("created_at", F.lit(day).cast("timestamp"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        if item == 4:
            for gone in tmp_path.glob("kept/batch=*/day=2024-01-01"):
                shutil.rmtree(gone)
        j.near_duplicate_stream(j.file_stream(spark, str(tmp_path / "in"), df.schema), kept, found, str(tmp_path / "ckpt"))
    assert sorted((r["item"], r["original"]) for r in found.read().collect()) == [(2, 1), (4, 3)]


def test_late_and_unordered_replays(spark, tmp_path):
    log = j.BatchLog(spark, str(tmp_path / "log"), "k bigint, ts timestamp, version int, v string")
    feeds = [[(1, "2024-01-01", 1, "a"), (2, "2024-01-10", 5, "b")], [(2, "2024-01-10", 4, "older"), (3, "2024-01-20", 1, "c")], [(1, "2024-01-01", 9, "too late"), (3, "2024-01-20", 2, "d")]]
    for f in feeds:
        df = spark.createDataFrame(f, "k bigint, ts string, version int, v string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        out = j.keyed_updates(j.file_stream(spark, str(tmp_path / "in"), df.schema), "k", "ts", "version", ["v"], "3 days", log, str(tmp_path / "ckpt"))
    assert sorted((r["k"], r["version"], r["v"]) for r in out.collect()) == [(1, 1, "a"), (2, 5, "b"), (3, 2, "d")]


def test_alerts_do_not_checkpoint_matches(spark, sf, tmp_path, monkeypatch):
    """The matches of a batch are a compressed table; null ids and offers that come again are alerts as before."""
    rows = [(i, "s", f"thing {i % 3}", float(i % 7 + 1), "C", "new", "active", float(i % 5)) for i in range(60)]
    offers = spark.createDataFrame(rows + rows[:10], "offer_id long, slot_id string, title string, price double, country string, cond string, status string, length_cm double")
    wants = spark.createDataFrame([(w, "s", "C", 3.0 + w, None, 1.0, 3.0, "thing") for w in range(4)], "want_id long, slot_id string, country string, budget double, cond string, lo double, hi double, title string")
    log = j.BatchLog(spark, str(tmp_path / "alerts"), j.ALERTS)
    monkeypatch.setattr(j.dedup, "cut_lineage", lambda df: 1 / 0)
    found = set()
    for n, part in enumerate((offers.where("offer_id % 2 = 0"), offers.where("offer_id % 2 = 1"))):
        part.write.mode("append").parquet(str(tmp_path / "offers"))
        j.match_alert_stream(j.file_stream(spark, str(tmp_path / "offers"), offers.schema), wants, log, str(tmp_path / "ckpt"), 5)
        so_far = offers.where("offer_id % 2 = 0") if n == 0 else offers
        found |= {(r["spec_id"], r["offer_id"]) for r in match.match_wants(wants, so_far.distinct(), 5).collect()}
    assert found and {(r["spec_id"], r["offer_id"]) for r in log.read().collect()} >= found
