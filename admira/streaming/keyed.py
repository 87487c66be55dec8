"""State tables from a stream of events, with keyed state: a batch costs the groups of its own keys only.

A ``KeyedFold`` says what is kept of a key. Its state merges events by their sequence numbers, so late, repeated and
replayed events leave what a fold over the whole log would give. Events are thinned in every input batch first, which is the
map-side combining that a hot key needs; the rest meets the key's state in ``transformWithState``. A call of the state costs
about a millisecond, so keys are dealt to ``GROUPS`` groups, whose states are read and written as one list. Changed keys are
merged into a bucketed table under the batch's number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.profiles import completeness
from ..sources import versioned
from ..sources.folders import stage
from .state import DEFAULT_TITLE, conversation_columns

#: Groups of keys, and events of a group that are held at a time.
GROUPS, AT_ONCE = 1024, 1 << 16
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class KeyedFold:
    """How a state table follows from events.

    ``prepare`` gives the columns ``keys`` and ``events`` (both DDL) of an event; ``thin`` drops events of a frame that
    others of it outdo; ``add`` gives the new state (of ``state``, DDL) from the old one, or None, and tuples of events;
    ``show`` gives the values of ``shown`` (DDL), or None where the key has no row; ``finish`` makes the final columns.
    """

    keys: str
    events: str
    state: str
    shown: str
    prepare: Callable[[DataFrame], DataFrame]
    thin: Callable[[pd.DataFrame], pd.DataFrame]
    add: Callable[[tuple | None, Iterable[tuple]], tuple]
    show: Callable[[tuple], tuple | None]
    finish: Callable[[DataFrame], DataFrame]

    @property
    def key_names(self) -> list[str]:
        return _names(self.keys)

    def merge(self, old: tuple | None, frames: Iterable[pd.DataFrame]) -> tuple:
        """``add`` of frames that have the columns of ``events`` among others."""
        names = _names(self.events)
        return self.add(old, (tuple(map(_plain, r)) for f in frames for r in zip(*[f[c].tolist() for c in names], strict=True)))

    @property
    def table(self) -> str:
        return f"{self.keys}, {self.shown}, gone boolean, batch long"


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _plain(v):
    """A value of a frame as Python's own; missing ones are None."""
    return None if v is None or v is pd.NA or v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v


class _Keyed(StatefulProcessor):
    """The states of a group of keys. Rows: number of the group, keys, events."""

    def __init__(self, fold: KeyedFold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getListState("states", f"{self.fold.keys}, {self.fold.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        n = len(self.fold.key_names)
        held = {t[:n]: t[n:] for t in map(tuple, self.states.get())}
        before = {}
        while some := [tuple(r)[1:] for r in islice(rows, AT_ONCE)]:
            events: dict[tuple, list[tuple]] = {}
            for r in some:
                events.setdefault(r[:n], []).append(r[n:])
            for k, more in events.items():
                old = held.get(k)
                new = self.fold.add(old, more)
                if new != old:
                    before.setdefault(k, old)
                    held[k] = new
        changed = [k for k, old in before.items() if held[k] != old]
        if not changed:
            return
        self.states.put([(*k, *v) for k, v in held.items()])
        none = (None,) * len(_names(self.fold.shown))
        made = Row(*self.fold.key_names, *_names(self.fold.shown), "gone")
        for k in changed:
            shown = self.fold.show(held[k])
            yield made(*k, *(none if shown is None else shown), shown is None)

    def close(self) -> None:
        pass


def stream_state(events: DataFrame, fold: KeyedFold, path: str, checkpoint: str, buckets: int = versioned.BUCKETS, groups: int = GROUPS):
    """Keep the table at ``path`` by a stream of events; ``read_state`` reads it. Returns the started query. ``groups`` must
    stay the same for a checkpoint."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = fold.prepare(events).select(*fold.key_names, *_names(fold.events))
    thinned = rows.mapInPandas(lambda frames: (fold.thin(f) for f in frames), rows.schema)
    dealt = thinned.select(versioned.bucket_of(fold.key_names, groups).alias("group"), *thinned.columns)
    changed = dealt.groupBy("group").transformWithState(_Keyed(fold), f"{fold.keys}, {fold.shown}, gone boolean", "Update", "None")

    def merge(batch: DataFrame, number: int) -> None:
        rows = stage(batch.withColumn("batch", F.lit(number).cast("long")), "changed")  # read twice, and the state is dear
        versioned.upsert(rows, path, fold.key_names, "batch", number, buckets)

    return changed.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, fold: KeyedFold, path: str) -> DataFrame:
    """The state table after the last batch."""
    return fold.finish(versioned.read(spark, path, fold.table).where("NOT gone").drop("gone", "batch"))


def shortlist_fold() -> KeyedFold:
    """What is saved now, from (seq, ts, student, entity, kind): of a key the last drop and the saves after it."""

    def prepare(events: DataFrame) -> DataFrame:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return events.select(F.col("student").alias("profile_id"), F.col("entity").alias("id"), "seq", us.alias("us"), (F.col("kind") == "save").alias("saved"), "kind").where("kind IN ('save', 'unsave') AND profile_id IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL")

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        drops = frame[~frame["saved"].astype(bool)].sort_values("seq").groupby(["profile_id", "id"], as_index=False).tail(1)
        last = frame[["profile_id", "id"]].merge(drops[["profile_id", "id", "seq"]], how="left", on=["profile_id", "id"])["seq"].to_numpy()
        kept = frame[frame["saved"].astype(bool).to_numpy() & ~(frame["seq"].to_numpy() <= last)].drop_duplicates()
        return pd.concat([drops, kept])

    def add(old, events):
        dropped, saves = (old[0], dict(zip(old[1], old[2], strict=True))) if old else (None, {})
        for seq, us, saved in events:
            if saved:
                saves[seq] = us
            else:
                dropped = seq if dropped is None else max(dropped, seq)
        kept = sorted((s, u) for s, u in saves.items() if dropped is None or s > dropped)
        return dropped, [s for s, _ in kept], [u for _, u in kept]

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select("profile_id", "id", F.timestamp_micros("us").cast("timestamp_ntz").alias("created_at"), "seq")

    return KeyedFold(
        "profile_id long, id long", "seq long, us long, saved boolean", "dropped long, seqs array<long>, times array<long>", "seq long, us long",
        prepare, thin, add, lambda s: (s[1][0], s[2][0]) if s[1] else None, finish,
    )


def last_values_fold(keys: str, values: str, prepare: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame]) -> KeyedFold:
    """Of each key the last of every value, each by its own events.

    ``prepare`` gives the keys, seq and, for each value ``v``, the value and ``has_v``: whether the event sets it.
    """
    keyed, parts = _names(keys), [p.split(" ", 1) for p in values.split(", ")]
    names = [p[0] for p in parts]

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.sort_values("seq", kind="stable")
        kept = {i for v in names for i in order[order[f"has_{v}"].astype(bool)].groupby(keyed, sort=False, dropna=False).tail(1).index}
        return frame.loc[sorted(kept)]

    def add(old, rows):
        seqs, last = (list(old[: len(names)]), list(old[len(names) :])) if old else ([None] * len(names), [None] * len(names))
        for seq, *values in rows:
            for i, (v, has) in enumerate(zip(values[::2], values[1::2], strict=True)):
                if has and (seqs[i] is None or seq > seqs[i]):
                    seqs[i], last[i] = seq, _plain(v)
        return (*seqs, *last)

    state = ", ".join([f"seq_{v} long" for v in names] + [f"{v} {t}" for v, t in parts])
    events = "seq long, " + ", ".join(f"{v} {t}, has_{v} boolean" for v, t in parts)
    return KeyedFold(keys, events, state, values, prepare, thin, add, lambda s: tuple(s[len(names) :]), finish)


def conversation_fold() -> KeyedFold:
    """``state.conversation_state`` of (seq, ts, conv, kind, title, filter)."""

    def prepare(events: DataFrame) -> DataFrame:
        title, alive = conversation_columns()
        rows = events.select("conv", "seq", title.alias("title"), F.col("filter").cast("string").alias("filter"), (F.col("kind") == "upsert").alias("has_filter"), alive.alias("alive"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        return rows.withColumns({"has_title": F.col("title").isNotNull(), "has_alive": F.col("alive").isNotNull(), "has_us": F.lit(True)})

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select("conv", F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"), "filter", F.coalesce(~F.col("alive"), F.lit(False)).alias("is_deleted"), F.timestamp_micros("us").cast("timestamp_ntz").alias("updated_at"))

    return last_values_fold("conv long", "title string, filter string, alive boolean, us long", prepare, finish)


def latest_fold(key: str, fields: str, order: str = "seq") -> KeyedFold:
    """``state.latest_by_key``: the last row of each key (DDL); null keys are skipped."""
    names = _names(fields)

    def prepare(events: DataFrame) -> DataFrame:
        kept = events.where(F.col(_names(key)[0]).isNotNull() & (F.col(_names(key)[0]).cast("string") != ""))
        return kept.select(_names(key)[0], F.col(order).alias("seq"), *names, *[F.lit(True).alias(f"has_{f}") for f in names])

    return last_values_fold(key, fields, prepare, lambda rows: rows)


def profile_fold(key: str, fields: str) -> KeyedFold:
    """``state.profile_state``: the last saved profile (``fields``, DDL) with its completeness; names and addresses are only
    overwritten by given ones."""
    names = _names(fields)

    def prepare(events: DataFrame) -> DataFrame:
        given = lambda f: F.col(f).isNotNull() if f in ("name", "email") else F.lit(True)
        return events.select(_names(key)[0], "seq", "kind", F.lit(True).alias("has_kind"), *names, *[given(f).alias(f"has_{f}") for f in names])

    def finish(rows: DataFrame) -> DataFrame:
        return completeness(rows.where("kind <> 'delete'").drop("kind"))

    return last_values_fold(key, f"kind string, {fields}", prepare, finish)
