"""State tables as folds over append-only event logs. ``keyed`` keeps the same tables by a stream.

Every fold is a group-by with order-insensitive aggregates (last value by sequence number), so partial results combine on
the map side and a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import title_from_message
from ..operators.profiles import completeness

DEFAULT_TITLE = "New Chat"


def shortlist_state(events: DataFrame) -> DataFrame:
    """(profile_id, id, created_at, seq) of what is saved now; created_at is the first save of the current run of saves.

    Events: seq, ts, student, entity, kind (save or unsave).
    """
    last_drop = F.max(F.when(F.col("kind") == "unsave", F.col("seq")))
    drops = events.groupBy("student", "entity").agg(last_drop.alias("dropped"))
    saves = events.where("kind = 'save'").join(drops, ["student", "entity"]).where(F.col("dropped").isNull() | (F.col("seq") > F.col("dropped")))
    return saves.groupBy(F.col("student").alias("profile_id"), F.col("entity").alias("id")).agg(F.min_by("ts", "seq").alias("created_at"), F.min("seq").alias("seq"))


def conversation_columns() -> tuple[Column, Column]:
    """The title that an event sets, or null, and whether it shows or hides the conversation, or null."""
    renamed = F.coalesce(F.nullif(F.substring(F.trim("title"), 1, 120), F.lit("")), F.lit(DEFAULT_TITLE))
    title = F.when(F.col("kind") == "rename", renamed).when(F.col("kind") == "upsert", F.col("title"))
    return title, F.when(F.col("kind") == "upsert", True).when(F.col("kind") == "delete", False)


def conversation_state(events: DataFrame) -> DataFrame:
    """One row for each conversation from its events (seq, ts, conv, kind, title, filter).

    upsert keeps the title where it is null, replaces the filter and undeletes; rename cuts at 120 and blanks fall back to
    the default; delete hides; touch only dates.
    """
    title, alive = conversation_columns()
    rows = events.withColumns({"new_title": title, "alive": alive})
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq")))
    return rows.groupBy("conv").agg(
        F.coalesce(last("new_title", F.col("new_title").isNotNull()), F.lit(DEFAULT_TITLE)).alias("title"),
        last("filter", F.col("kind") == "upsert").alias("filter"),
        F.coalesce(~last("alive", F.col("alive").isNotNull()), F.lit(False)).alias("is_deleted"),
        F.max("ts").alias("updated_at"),
    )


def active_conversations(state: DataFrame) -> DataFrame:
    return state.where(~F.col("is_deleted"))


def auto_title(messages: DataFrame, conversations: DataFrame, default: str = DEFAULT_TITLE) -> DataFrame:
    """Conversations that still bear the default title get one from their first user message."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return conversations.join(first, "conv_id", "left").withColumn("title", F.when((F.col("title") == default) & F.col("first").isNotNull(), title_from_message(F.col("first"))).otherwise(F.col("title"))).drop("first")


def append_messages(batch: DataFrame, conversations: DataFrame) -> DataFrame:
    """What of a batch is stored: trimmed messages that are not empty, of known conversations."""
    return batch.withColumn("text", F.trim("text")).where("text != ''").join(conversations.select("conv_id"), "conv_id", "left_semi")


def purge_conversations(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def latest_by_key(events: DataFrame, key: str, fields: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key that has one; null and empty keys are skipped."""
    kept = events.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("s")).select(key, *[F.col(f"s.{f}").alias(f) for f in fields])


def profile_state(events: DataFrame, fields: list[str]) -> DataFrame:
    """The last saved profile of each student with its completeness; a later delete removes it. Names and addresses are
    only overwritten by given ones."""
    kept = events.groupBy("student").agg(
        F.max_by(F.struct("kind", *fields), "seq").alias("s"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"k_{c}") for c in ("name", "email") if c in fields],
    )
    out = kept.where("s.kind != 'delete'").select("student", *[(F.col(f"k_{f}") if f in ("name", "email") else F.col(f"s.{f}")).alias(f) for f in fields])
    return completeness(out)


def ensure_students(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """One id for each session; known ones keep theirs, new ones are made from the session."""
    new = sessions.select("session_id").distinct().join(known.select("session_id"), "session_id", "left_anti")
    return known.select("session_id", "id").unionByName(new.select("session_id", F.sha2(F.col("session_id").cast("string"), 256).alias("id")))


def list_conversations(state: DataFrame, owner: str, limit: int = 30) -> DataFrame:
    """The newest conversations of each owner."""
    return state.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("updated_at"), "conv"))).where(F.col("place") <= limit)


def ordered_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("ts", "turn")))


def owned_messages(messages: DataFrame, conversations: DataFrame, owner: int | str) -> DataFrame:
    """Messages of the owner's conversations that are not deleted."""
    return messages.join(conversations.where((F.col("owner") == F.lit(owner)) & ~F.col("is_deleted")), "conv_id", "left_semi")


def agent_context(profiles: DataFrame, shortlist: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row for each profile: completeness, missing fields, saved ids and recommended ids, each with its number."""
    saved = shortlist.groupBy("profile_id").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("saved_ids"), F.count_distinct("id").alias("n_saved"))
    best = ranked.groupBy("profile_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]), ",").alias("recommended"), F.count(F.lit(1)).alias("n_recommended"))
    out = profiles.join(saved, "profile_id", "left").join(best, "profile_id", "left")
    return out.select("profile_id", "completeness_pct", F.array_join("missing", ",").alias("missing"), F.coalesce("saved_ids", F.lit("")).alias("saved_ids"), F.coalesce("n_saved", F.lit(0)).alias("n_saved"), F.coalesce("recommended", F.lit("")).alias("recommended"), F.coalesce("n_recommended", F.lit(0)).alias("n_recommended"))
