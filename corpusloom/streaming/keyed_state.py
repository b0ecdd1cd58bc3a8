"""Operation logs as keyed state with bounds (T1, F31), and the queue of a client against its acknowledgements (T2), as streams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .user_state import clean_ops

#: Fixed value: the keys that a user's map may hold.
MAP_KEYS = 5000
#: Days after which a queue entry that wasn't touched expires.
QUEUE_DAYS = 30
DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: the buckets that maps are dealt to. A call of Python has a batch's operations on all maps of a bucket.
BUCKETS = 1024
UPDATES = "user string, type string, item_id string, active boolean, text string, keywords array<string>, at long, seq long, queue_key string, reason string"
_MAP = "item_id array<string>, stays array<boolean>, at array<long>, seq array<long>, timers array<long>"


def is_on(kind: str, active, text, keywords) -> bool:
    """Whether an operation leaves an item in its map."""
    if kind in ("favorite", "ignored"):
        return bool(active)
    if kind == "note":
        return bool(text)
    if kind == "keywords":
        return len(keywords) > 0
    return True


class MapsOfUsers(StatefulProcessor):
    """Maps of users by type, a bucket of them in a call. An item keeps its last operation, by time and ``seq``; one that came late from the
    source's order changes nothing. A full map takes no new item. What is switched off stays as a tombstone until the watermark has passed
    it, and queue entries expire ``queue_days`` after their last operation; both at the end of a day of event time.

    A map is one value of the state: the items with whether they are there, their times and numbers, and the map's timers. It is
    read and written once a batch. Texts and keywords go out with the updates and decide nothing later, so they aren't in it."""

    def __init__(self, most: int, queue_days: int) -> None:
        self.most, self.queue_days = most, queue_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = handle.getMapState("maps", "user string, type string", _MAP)

    def _map(self, name: tuple) -> tuple[dict[str, tuple], list[int]]:
        value = self.maps.getValue(name)
        if value is None:
            return {}, []
        items, stays, at, seq, timers = value
        return dict(zip(items, zip(stays, at, seq))), list(timers)

    def _keep(self, name: tuple, items: dict[str, tuple], timers: list[int]) -> None:
        if items or timers:
            held = list(items.values())
            self.maps.updateValue(name, (list(items), *[[v[i] for v in held] for i in range(3)], timers))
        else:
            self.maps.removeKey(name)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(rows, ignore_index=True).sort_values(["user", "type", "at", "seq"], kind="stable")
        columns = [ops[c].tolist() for c in ("user", "type", "item_id", "active", "text", "keywords", "at", "seq", "queue_key")]
        given, wake = [], set()
        for name, mine in groupby(zip(*columns), key=lambda op: op[:2]):
            kind = name[1]
            items, timers = self._map(name)
            held = sum(v[0] for v in items.values())
            out: dict[str, tuple] = {}
            for _, _, item, active, text, words, at, seq, queue_key in mine:
                before = items.get(item)
                if before is not None and (at, seq) <= before[1:]:
                    continue
                words = list(words) if words is not None else []
                there, stays = before is not None and before[0], is_on(kind, active, text, words)
                reason = "set" if stays else "cleared"
                if stays and not there and held >= self.most:
                    stays, reason = False, "full"
                held += int(stays) - int(there)
                items[item] = (stays, at, int(seq))
                shown = (bool(active), text, words) if stays else (False, "", [])
                out[item] = (*name, item, *shown, at, int(seq), queue_key if kind == "queue" else None, reason)
            if out:
                wake.update(self._due(kind, max(row[6] for row in out.values()), timers))
                self._keep(name, items, timers)
                given += out.values()
        self._wake(wake)
        yield self._rows(given)

    def _due(self, kind: str, at: int, timers: list[int]) -> list[int]:
        """The end of the day on which the latest of a map's items is due, entered in ``timers``, unless the map has that one or a later one."""
        days = self.queue_days if kind == "queue" else 0
        due = (at // 1000 // DAY_MS + days + 1) * DAY_MS
        if timers and max(timers) >= due:
            return []
        timers.append(due)
        return [due]

    def _wake(self, wake: set[int]) -> None:
        """Timers of the bucket, one for all maps that are due then."""
        if wake:
            for due in sorted(wake - set(self.handle.listTimers())):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        given, wake = [], set()
        for name in [tuple(name) for name, value in self.maps.iterator() if now in value[4]]:
            kind = name[1]
            items, timers = self._map(name)
            timers.remove(now)
            later = 0
            for item, (stays, at, seq) in list(items.items()):
                due = at // 1000 + (self.queue_days * DAY_MS if kind == "queue" and stays else 0)
                if due < now and (not stays or kind == "queue"):
                    del items[item]
                    if stays:
                        given.append((*name, item, False, "", [], at, seq, None, "expired"))
                elif not stays or kind == "queue":
                    later = max(later, at)
            if later:
                wake.update(self._due(kind, later, timers))
            self._keep(name, items, timers)
        self._wake(wake)
        yield self._rows(given)

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user", "type", "item_id", "active", "text", "keywords", "at", "seq", "queue_key", "reason"])

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the state store of RocksDB; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def fold_user_ops_bounded(ops: DataFrame, watermark: str = "7 days", most: int = MAP_KEYS, queue_days: int = QUEUE_DAYS) -> DataFrame:
    """T1 as a stream with bounds: updates of ``user, type, item_id`` (the last of each, by ``ts, seq``, is its state), with the
    operation's own switch (``active``) and what became of it: set, cleared, full (a map had ``most`` items) or expired. Queue entries
    have ``queue_key``, the hash of user and item. Operations behind the watermark are dropped, null times too. State per user
    and type: at most ``most`` items, and tombstones of the time that the watermark spans. Maps are dealt to ``BUCKETS`` by a hash, and what
    is kept for a bucket can't be read by a checkpoint with another number of them, or of the layout before, by user and type."""
    cleaned = clean_ops(ops).where("ts is not null").withColumn("queue_key", F.sha2(F.concat_ws(":", F.col("user").cast("string"), "item_id"), 256))
    ts = F.col("ts").cast("timestamp")
    slim = cleaned.select(
        F.pmod(F.xxhash64(F.col("user").cast("string"), "type"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("user").cast("string").alias("user"), "type", "item_id", "active", "text", "keywords",
        ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("seq").cast("long").alias("seq"), "queue_key",
    )
    updates = slim.withWatermark("ts", watermark).groupBy("bucket").transformWithStateInPandas(MapsOfUsers(most, queue_days), UPDATES, "Update", "EventTime")
    return updates.select(F.col("user").cast(ops.schema["user"].dataType).alias("user"), "type", "item_id", "active", "text", "keywords", F.timestamp_micros("at").alias("ts"), "seq", "queue_key", "reason")


def settled_items(updates: DataFrame) -> DataFrame:
    """The items that are there, out of a bounded fold's updates: the last update of each, unless it cleared it."""
    last = updates.groupBy("user", "type", "item_id").agg(F.max_by(F.struct("active", "text", "keywords", "seq", "queue_key", "reason"), F.struct("ts", "seq", F.col("reason") == "expired")).alias("p"))
    return last.select("user", "type", "item_id", "p.*").where("reason = 'set'").drop("reason")


def acknowledged_ops(ops: DataFrame, acks: DataFrame, late: str = "1 day", horizon: str = "7 days") -> DataFrame:
    """T2 as a stream: every operation once, with whether it was acknowledged within ``horizon``. ``ops`` and ``acks(op_id, ts)`` may repeat and
    come ``late``; what is later is dropped. An operation comes out when its acknowledgement is there, or when none can come any more."""
    mine = clean_ops(ops).select("op_id", "user", "type", "item_id", "ts", "seq").withWatermark("ts", late).dropDuplicatesWithinWatermark(["op_id"])
    theirs = acks.select(F.col("op_id").cast("string").alias("ack_id"), F.col("ts").alias("ack_ts")).withWatermark("ack_ts", late).dropDuplicatesWithinWatermark(["ack_id"])
    near = F.expr(f"op_id = ack_id and ack_ts >= ts and ack_ts <= ts + interval {horizon}")
    return mine.join(theirs, near, "left_outer").select("op_id", "user", "type", "item_id", "ts", "seq", F.col("ack_id").isNotNull().alias("acknowledged"))


def remaining_queue(judged: DataFrame) -> DataFrame:
    """The newest operation per user, type and item, unless it was acknowledged, out of ``acknowledged_ops``' rows."""
    last = judged.groupBy("user", "type", "item_id").agg(F.max_by(F.struct("op_id", "seq", "acknowledged"), F.struct("ts", "seq")).alias("p"))
    return last.where("not p.acknowledged").select("user", "type", "item_id", "p.op_id", "p.seq")
