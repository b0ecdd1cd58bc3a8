"""Keyed state against a fold in sequence, queues against their acknowledgements, snapshots against plain merges."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import keyed_state, user_state

OPS = "op_id string, user long, ts timestamp, item_id string, type string, active boolean, text string, keywords array<string>, seq long"
START = dt.datetime(2024, 1, 1)


def ops_of(rnd, n, users=3, items=14, days=20):
    return [
        (f"op{i}", rnd.randint(1, users), START + dt.timedelta(seconds=rnd.randint(0, days * 86400)), f"i{rnd.randint(0, items)}", rnd.choice(list(user_state.TYPES)),
         rnd.random() < 0.7, rnd.choice(["", " ", " note ", "x"]), rnd.choice([None, [], ["A", "a", " b "]]), i)
        for i in range(n)
    ]


def in_sequence(batches, most):
    """Batches one after the other, each in the order of its times; older operations than an item's last change nothing."""
    maps, last = {}, {}
    for batch in batches:
        for _, user, ts, item, kind, active, text, words, seq in sorted(batch, key=lambda r: (r[2], r[8])):
            if (user, kind, item) in last and (ts, seq) <= last[user, kind, item]:
                continue
            last[user, kind, item] = (ts, seq)
            words = [w for i, w in enumerate(words or []) if w.strip().lower() not in [x.strip().lower() for x in words[:i]]]
            words = [w.strip() for w in words]
            stays = {"favorite": active, "ignored": active, "note": bool(text.strip()), "keywords": bool(words), "queue": True}[kind]
            own = maps.setdefault((user, kind), {})
            if not stays:
                own.pop(item, None)
            elif item in own or len(own) < most:
                own[item] = (text.strip(), tuple(words), seq)
    return {(u, k, i): v for (u, k), own in maps.items() for i, v in own.items()}


def run(spark, stream, folder, mode="update"):
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def fed(spark, batches, schema, folder, name="in"):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed_state.use_keyed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


@pytest.mark.parametrize("most,seed", [(5000, 1), (4, 2)])
def test_bounded_state_equals_a_fold_in_sequence(spark, folder, rocks, most, seed):
    rnd = random.Random(seed)
    ops = ops_of(rnd, 240)
    batches = [ops[i : i + 80] for i in range(0, 240, 80)]
    stream = keyed_state.fold_user_ops_bounded(fed(spark, batches, OPS, folder), "60 days", most, 365)
    got = {(r.user, r.type, r.item_id): (r.text, tuple(r.keywords), r.seq) for r in keyed_state.settled_items(run(spark, stream, folder)).collect()}
    want = in_sequence(batches, most)
    assert got == want
    if most == 4:
        assert max(sum(k[:2] == (u, t) for k in want) for u in (1, 2, 3) for t in user_state.TYPES) == 4
    else:
        batch = user_state.fold_user_ops(spark.createDataFrame(ops, OPS))
        assert {(r.user, r.type, r.item_id): r.seq for r in batch.collect()} == {k: v[2] for k, v in got.items()}


def test_queue_entries_expire(spark, folder, rocks):
    row = lambda i, day, item, kind: (f"op{i}", 1, START + dt.timedelta(days=day), item, kind, True, "n", None, i)
    batches = [[row(0, 0, "a", "queue"), row(1, 3, "b", "queue"), row(2, 0, "n", "note")], [row(3, 12, "c", "queue"), row(4, 12, "n2", "note")], [row(5, 14, "d", "queue")], [row(6, 15, "e", "queue")]]
    out = run(spark, keyed_state.fold_user_ops_bounded(fed(spark, batches, OPS, folder), "0 days", queue_days=7), folder)
    expired = {r.item_id for r in out.where("reason = 'expired'").collect()}
    assert expired == {"a", "b"}
    there = {r.item_id: r.queue_key for r in keyed_state.settled_items(out).collect()}
    assert set(there) == {"c", "d", "e", "n", "n2"} and len(there["c"]) == 64 and there["n"] is None


class Counted:
    """A state without a store, which counts its calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getMapState(self, name, key, value):
        return self

    def getValue(self, name):
        self.calls += 1
        return self.held.get(name)

    def updateValue(self, name, value):
        self.calls += 1
        self.held[name] = value

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, due):
        self.calls += 1
        self.timers.add(due)


def test_a_map_is_read_and_written_once_a_batch():
    state = Counted()
    maps = keyed_state.MapsOfUsers(5000, 30)
    maps.init(state)
    ops = [(str(n % 4), "note", f"i{n % 50}", True, "x", None, n * 1000, n, "") for n in range(2000)] + [(None, "queue", "i", None, "", None, 5, 1, "k")]
    rows = pd.DataFrame(ops, columns=["user", "type", "item_id", "active", "text", "keywords", "at", "seq", "queue_key"])
    out = pd.concat(maps.handleInputRows((0,), iter([rows[:1500], rows[1500:]]), None))
    assert len(out) == 101 and state.calls == 2 * 5 + 1 + 2
    assert {name: len(value[0]) for name, value in state.held.items()} == {**{(str(u), "note"): 25 for u in range(4)}, (None, "queue"): 1}


def test_users_without_a_name_and_of_any_type_keep_their_maps(spark, folder, rocks):
    ops = [("a", 0), (None, 1), ("b", 2), (None, 3)]
    rows = [(f"op{i}", u, START, f"i{i}", "note", True, "n", None, i) for u, i in ops]
    stream = keyed_state.fold_user_ops_bounded(fed(spark, [rows], OPS.replace("user long", "user string"), folder), "0 days")
    assert sorted((str(r.user), r.item_id) for r in keyed_state.settled_items(run(spark, stream, folder)).collect()) == [("None", "i1"), ("None", "i3"), ("a", "i0"), ("b", "i2")]


def test_acknowledged_queue_equals_its_batch(spark, folder):
    rnd = random.Random(3)
    ops = [o for o in ops_of(rnd, 120, days=6)]
    acked = [(o[0], o[2] + dt.timedelta(minutes=rnd.randint(0, 2000))) for o in ops if rnd.random() < 0.5]
    end = ("end", 9, START + dt.timedelta(days=60), "i", "note", True, "x", None, 999)
    doubled = [ops[:60] + ops[:20], ops[40:], [end]]
    acks = [acked[:30] + acked[:5], acked[20:], [("none", END_TS := end[2])]]
    stream = keyed_state.acknowledged_ops(fed(spark, doubled, OPS, folder, "ops"), fed(spark, acks, "op_id string, ts timestamp", folder, "acks"), "10 days", "7 days")
    out = run(spark, stream, folder, "append")
    judged = out.where("op_id <> 'end'")
    assert judged.count() == judged.select("op_id").distinct().count() == 120
    got = {(r.user, r.type, r.item_id, r.op_id) for r in keyed_state.remaining_queue(judged).collect()}
    batch = user_state.compact_queue(spark.createDataFrame(ops, OPS), spark.createDataFrame(acked, "op_id string, ts timestamp"))
    assert got == {(r.user, r.type, r.item_id, r.op_id) for r in batch.collect()}


SNAPSHOT = """user long, updated_at string, legacy boolean, favorites map<string,string>, read_status map<string,string>, notes map<string,string>, translation_favorites map<string,string>, keywords array<string>,
 glossary array<struct<source:string,target:string>>, code_items array<struct<id:string,url:string,title:string,n:int>>, resources array<struct<id:string,url:string,title:string,n:int>>, hidden array<string>, ignored array<string>"""


def snapshot(rnd, user):
    words = lambda n: [rnd.choice(["a", "A", "b ", "B", "c"]) for _ in range(rnd.randint(0, n))]
    mapped = lambda: {w.strip(): str(rnd.randint(0, 9)) for w in words(3)}
    items = lambda: [(rnd.choice([None, "", "1", "2"]), rnd.choice([None, "u", "v"]), rnd.choice([None, "t"]), rnd.randint(0, 99)) for _ in range(rnd.randint(0, 4))]
    terms = [(rnd.choice([" x", "X", "y", ""]), rnd.choice(["1", "2 ", ""])) for _ in range(rnd.randint(0, 4))]
    return (user, rnd.choice(["2026-01-01T00:00:00Z", "2026-01-02T00:00:00.250Z", "2026-01-02T00:00:00.500Z", "", "bad", None]), rnd.choice([True, False, None]), mapped(), mapped(), mapped(), mapped(), words(4), terms, items(), items(), words(3), words(3))


def plain_merge(remote, local):
    def union(values):
        return list(dict.fromkeys(values))

    def keyed(name, items):
        out = {}
        for i, x in enumerate(items):
            out[x[0] or x[1] or x[2] or f"{name}-{i}"] = x
        return list(out.values())

    def folded(pairs):
        out = {}
        for a, b in pairs:
            if a.strip() and b.strip():
                out.setdefault(a.strip().lower(), (a.strip(), b.strip()))
        return list(out.values())

    def ci(words):
        out = {}
        for w in words:
            if w.strip():
                out.setdefault(w.strip().lower(), w.strip())
        return list(out.values())

    maps = [{**a, **b} for a, b in zip(remote[:4], local[:4])]
    return [*maps, ci(remote[4] + local[4]), folded(remote[5] + local[5]), keyed("code_items", remote[6] + local[6]), keyed("resources", remote[7] + local[7]), union(remote[8] + local[8]), union(remote[9] + local[9])]


def test_snapshots_reconcile_as_plain_ones(spark):
    rnd = random.Random(11)
    remote, local = ({u: snapshot(rnd, u) for u in rnd.sample(range(60), 45)} for _ in range(2))
    got = user_state.reconcile_snapshots(spark.createDataFrame(list(remote.values()), SNAPSHOT), spark.createDataFrame(list(local.values()), SNAPSHOT)).collect()
    when = {"2026-01-01T00:00:00Z": 1, "2026-01-02T00:00:00.250Z": 2, "2026-01-02T00:00:00.500Z": 3}
    seen = set()
    for row in got:
        nothing = [{}, {}, {}, {}, [], [], [], [], [], []]
        r, l = list(remote.get(row.user, [0] * 3 + nothing)), list(local.get(row.user, [0] * 3 + nothing))  # noqa: E741
        if row.user in local and l[2] and any(l[3:]):
            want, source = plain_merge(r[3:], l[3:]), "merged"
        elif row.user in local and not l[2] and when.get(l[1], 0) > (when.get(r[1], 0) if row.user in remote else 0):
            want, source = l[3:], "local"
        else:
            want, source = r[3:], "remote"
        plain = [[tuple(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, list) else v for v in row[2:]]
        assert row["from"] == source and plain == want, row.user
        seen.add(source)
    assert seen == {"merged", "local", "remote"} and len(got) == len(set(remote) | set(local))


def test_latest_status_as_a_stream(spark, folder):
    rnd = random.Random(5)
    schema = "name string, kind string, ok boolean, count long, run_at timestamp, seq long"
    runs = [(f"s{rnd.randint(0, 4)}", "paper", rnd.random() < 0.5, i, START + dt.timedelta(hours=rnd.randint(0, 99)), i) for i in range(60)]
    stream = user_state.latest_source_status(fed(spark, [runs[:20], runs[20:50], runs[50:]], schema, folder))
    out = run(spark, stream, folder)
    last = out.groupBy("name").agg(F.max(F.struct("run_at", "count", "ok")).alias("p")).select("name", "p.*")
    want = user_state.latest_source_status(spark.createDataFrame(runs, schema)).select("name", "run_at", "count", "ok")
    assert sorted(map(tuple, last.select("name", "run_at", "ok").collect())) == sorted((r.name, r.run_at, r.ok) for r in want.collect())
