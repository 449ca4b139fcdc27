"""Keyed upkeep of reference tables and worklists: change feeds, scoped replacement, counters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_summary(changes: DataFrame) -> DataFrame:
    """What all changes of a key come to: one aggregation per key, combined map-side, and as a stream a state
    of one row a key. ``changes``: key, pos (orderable), kind in (upsert, delete, placeholder), name, updated_at."""
    up, gone, known = F.col("kind") == "upsert", F.col("kind") == "delete", F.col("kind") != "delete"
    return changes.groupBy("key").agg(
        F.max_by("name", F.when(up, F.col("pos"))).alias("new_name"), F.max(F.when(up, F.col("pos"))).alias("last_up"),
        F.max(F.when(gone, F.col("pos"))).alias("last_gone"), F.min(F.when(known, F.col("pos"))).alias("first_known"),
        F.max(F.when(up, F.col("updated_at"))).alias("new_at"))


def apply_summary(state: DataFrame, per_key: DataFrame) -> DataFrame:
    """A keyed table (key, name, deleted, updated_at) after the changes that were summed up."""
    s = state.select("key", F.col("name").alias("old_name"), F.col("deleted").alias("old_deleted"), F.col("updated_at").alias("old_at"))
    j = s.join(per_key, "key", "full_outer").withColumn("_known", F.col("old_deleted").isNotNull())
    gone_last = F.col("last_gone").isNotNull() & (F.col("_known") | F.coalesce(F.col("last_gone") > F.col("first_known"), F.lit(False)))
    gone_last = gone_last & (F.col("last_up").isNull() | (F.col("last_gone") > F.col("last_up")))
    return j.where(F.col("_known") | F.col("first_known").isNotNull()).select(
        "key", F.when(F.col("last_up").isNotNull(), F.col("new_name")).otherwise(F.coalesce("old_name", F.lit("(closed or merged)"))).alias("name"),
        F.when(gone_last, True).when(F.col("last_up").isNotNull(), False).otherwise(F.coalesce("old_deleted", F.lit(False))).alias("deleted"),
        F.coalesce("new_at", "old_at").alias("updated_at"))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply an ordered change feed to a keyed table.

    A delete marks a row that is known by then; a payload without name only creates a row; an upsert replaces
    it and lifts the mark.
    """
    return apply_summary(state, change_summary(changes))


def sync_vocabulary(have: DataFrame, wanted: DataFrame, origin: str = "seed") -> DataFrame:
    """``(slot_id, alias, origin)`` against the seed list ``(slot_id, alias)``: missing aliases are added,
    seed aliases that left the list are removed, other origins stay. Aliases compare without case."""
    h = have.select("slot_id", F.lower("alias").alias("_k"), F.col("alias").alias("_have"), F.col("origin").alias("_origin"))
    w = wanted.groupBy("slot_id", F.lower("alias").alias("_k")).agg(F.min("alias").alias("_want"))
    return h.join(w, ["slot_id", "_k"], "full_outer").select(
        "slot_id", F.coalesce("_have", "_want").alias("alias"), F.coalesce("_origin", F.lit(origin)).alias("origin"),
        F.when(F.col("_have").isNull(), "added").when((F.col("_origin") == origin) & F.col("_want").isNull(), "removed").otherwise("kept").alias("action"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent present in ``new`` are replaced whole; other parents keep theirs."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def add_counters(prior: DataFrame, seen: DataFrame) -> DataFrame:
    """Additive upsert of ``handle`` counters with first and last sighting."""
    cols = ["handle", "mentions", "forwards", "crawls", "first_seen", "last_seen"]
    return prior.select(cols).unionByName(seen.select(cols)).groupBy("handle").agg(
        *[F.sum(c).alias(c) for c in ("mentions", "forwards", "crawls")], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def pending(counters: DataFrame, evaluated: DataFrame, limit: int = 30) -> DataFrame:
    score = F.col("mentions") + F.col("forwards") * 2 + F.col("crawls")
    return counters.join(evaluated.select("handle"), "handle", "left_anti").withColumn("score", score).orderBy(
        F.col("score").desc(), F.col("last_seen").desc(), "handle").limit(limit)


def worklist(rows: DataFrame, profiles: list[str], min_score: float, priority_min: float | None, limit: int) -> DataFrame:
    """Unharvested rows that reach their threshold; priority profiles first, then by score."""
    first = F.coalesce(F.col("profile").isin(profiles), F.lit(False))
    ok = (first & (F.col("score") >= (min_score if priority_min is None else priority_min))) | (F.col("score") >= min_score)
    return rows.where(F.col("harvested_at").isNull() & ok).withColumn("is_priority", first).orderBy(
        F.col("is_priority").desc(), F.col("score").desc(), "key").limit(limit)


def mark_evaluated(rows: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Set score and evaluation time; the proposal time changes only when proposed now."""
    return rows.join(verdicts.select("key", "quality", "proposed"), "key", "left").select(
        "key", F.coalesce("quality", "score").alias("score"), F.when(F.col("quality").isNotNull(), now).otherwise(F.col("evaluated_at")).alias("evaluated_at"),
        F.when(F.coalesce("proposed", F.lit(False)), now).otherwise(F.col("proposed_at")).alias("proposed_at"))
