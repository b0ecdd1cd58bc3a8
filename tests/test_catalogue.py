"""The stored catalogue: equal to merges of whole frames, without moving what is stored; commits, replays and broken writes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalogue as stored_catalogue
from corpusloom.operators import merge
from corpusloom.operators.catalogue import Catalogue, History
from corpusloom.sources.sinks import publish_history, published_papers, published_stats
from corpusloom.sources.snapshots import Conflict, Snapshots

PAPER = "id string, seq long, title string, source_type string, doi string, abstract string, published string, importance long, categories array<string>, tags array<string>, last_seen string"


def rows(rnd, first, n, ids=12):
    return [
        (
            rnd.choice([f"p{rnd.randint(0, ids)}"] * 12 + ["", None]), first + i, rnd.choice(["One", "two!", "TWO", "Three", "!!!", "---", "Four", None, f"t{rnd.randint(0, 9)}"]),
            rnd.choice(["journal", "preprint", ""]), rnd.choice(["", "10.1/a", "10.1/b"]), rnd.choice(["", "text", "other"]), rnd.choice(["2024-01-01", "2024-02-01", None]),
            rnd.randint(0, 100), rnd.sample("abcdef", rnd.randint(0, 3)), rnd.sample("uvwxyz", rnd.randint(0, 3)), rnd.choice(["", "d1", "d2"]),
        )
        for i in range(n)
    ]


def content(df):
    return sorted((tuple(map(str, r)) for r in df.drop("slice").collect()))


@pytest.mark.parametrize("seed,log_parts", [(1, 32), (2, 2)])
def test_batches_equal_merges_of_the_whole(spark, folder, monkeypatch, seed, log_parts):
    monkeypatch.setattr(stored_catalogue, "LOG_PARTS", log_parts)
    rnd = random.Random(seed)
    c = Catalogue(spark, f"{folder}/c", buckets=3, slices=4)
    c.create(spark.createDataFrame([r for r in rows(rnd, 0, 15) if r[2]], PAPER))
    for batch in range(3):
        before = spark.createDataFrame(c.papers().collect(), PAPER)
        incoming = spark.createDataFrame([r for r in rows(rnd, 100 * (batch + 1), 14, 20)], PAPER)
        want = merge.merge_records(before, incoming).where("id <> ''")
        fresh = merge.new_records(before, incoming)
        assert content(c.new_records(incoming)) == content(fresh)
        state = c.merge(incoming)
        assert state["version"] == batch + 2 and content(c.papers()) == content(want)
        assert c.papers().groupBy("id").count().where("count > 1").count() == 0
    assert len(state["tables"]["titles"]) <= max(log_parts, 4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(plan, scan):
    """For each scan of ``scan``, the operators between it and the root that move rows."""
    lines, out = plan.splitlines(), []
    depth = lambda s: len(re.match(r"[\s:|+\-*()\d]*", s)[0])
    for at, line in enumerate(lines):
        if "FileScan" in line and scan in line:
            d = depth(line)
            for up in reversed(lines[:at]):
                if depth(up) < d:
                    d = depth(up)
                    if "Exchange" in up:
                        out.append(up.strip())
    return out


def test_what_is_stored_does_not_move(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rnd = random.Random(3)
        c = Catalogue(spark, f"{folder}/c", buckets=5, slices=3)
        state = c.create(spark.createDataFrame(rows(rnd, 0, 40, 60), PAPER))
        batch = spark.createDataFrame(rows(rnd, 100, 20, 60), PAPER)
        keys = batch.select(F.lower("title").alias("_key")).distinct()
        targets = batch.select("id").distinct()
        for plan in (
            plan_of(c.known(state, keys).groupBy().count()),
            plan_of(c.records(state).where("slice in (0, 2)").join(targets, "id", "left_semi")),
            plan_of(c.rewritten(state, batch, [0, 2])),
        ):
            assert "Bucketed: true" in plan and "FileScan" in plan
        assert not exchanges_above(plan_of(c.records(state).where("slice in (0, 2)").join(targets, "id", "left_semi")), "_records_")
        assert not exchanges_above(plan_of(c.rewritten(state, batch, [0, 2])), "_records_")
        assert "slice" in re.search(r"PartitionFilters: \[[^\]]*\]", plan_of(c.rewritten(state, batch, [0, 2])))[0]
        log = plan_of(c.title_log(state).join(keys, "_key", "left_semi").groupBy("_key", "id").agg(F.max("at")))
        assert not exchanges_above(log, "_titles_")
        h = History(spark, f"{folder}/h", buckets=5)
        h.create(batch)
        assert not exchanges_above(plan_of(h.union(batch, 2001)), "_history_")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_untouched_slices_keep_their_files(spark, folder):
    rnd = random.Random(4)
    c = Catalogue(spark, f"{folder}/c", buckets=2, slices=8)
    before = c.create(spark.createDataFrame(rows(rnd, 0, 60, 80), PAPER))
    after = c.merge(spark.createDataFrame([("p1", 200, "Quite new", "journal", "", "", None, 1, [], [], "")], PAPER))
    changed = [k for k, v in after["tables"]["records"].items() if before["tables"]["records"].get(k) != v]
    assert len(changed) == 1


def test_a_batch_that_comes_again_changes_nothing(spark, folder, monkeypatch):
    rnd = random.Random(5)
    c = Catalogue(spark, f"{folder}/c", buckets=2, slices=2)
    first = c.create(spark.createDataFrame(rows(rnd, 0, 20), PAPER))
    batch = spark.createDataFrame(rows(rnd, 100, 20), PAPER)
    want = content(merge.merge_records(c.papers(first), batch).where("id <> ''"))
    # stopped between the write and the commit: nothing is to be seen
    commit = Snapshots.commit
    monkeypatch.setattr(Snapshots, "commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        c.merge(batch, ("s", 0))
    monkeypatch.setattr(Snapshots, "commit", commit)
    assert c.snapshots.versions() == [1] and content(c.papers()) == content(c.papers(first))
    done = c.merge(batch, ("s", 0))
    again = c.merge(batch, ("s", 0))
    assert done == again and c.snapshots.versions() == [1, 2] and content(c.papers()) == want
    assert c.merge(batch.limit(0), ("s", 1))["batches"] == {"s": 1} and content(c.papers()) == want
    assert content(c.papers(first)) != want  # the older version is there still


def test_streamed_batches(spark, folder):
    rnd = random.Random(6)
    c = Catalogue(spark, f"{folder}/c", buckets=2, slices=2)
    start = spark.createDataFrame(rows(rnd, 0, 20), PAPER)
    c.create(start)
    now = spark.createDataFrame(c.papers().collect(), PAPER)
    for n in range(2):
        batch = spark.createDataFrame(rows(rnd, 100 * (n + 1), 10), PAPER)
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(now.schema).parquet(f"{folder}/in")
        c.merge_stream(stream, "s").option("checkpointLocation", f"{folder}/k").trigger(availableNow=True).start().awaitTermination()
        now = spark.createDataFrame(merge.merge_records(now, batch).where("id <> ''").collect(), PAPER)
    assert content(c.papers()) == content(now) and c.snapshots.state()["batches"] == {"s": 1}


def test_of_two_writers_one_wins(spark, folder):
    s = Snapshots(spark, f"{folder}/s")
    state = s.state()
    s.commit(state)
    with pytest.raises(Conflict):
        s.commit(state)
    assert s.versions() == [1] and s.state()["version"] == 1


def test_history_equals_the_union_of_whole_frames(spark, folder):
    rnd = random.Random(7)
    mine, shards = (spark.createDataFrame([r for r in rows(rnd, n, 30) if r[0]], PAPER) for n in (0, 100))
    h = History(spark, f"{folder}/h", buckets=3)
    h.create(shards)
    assert content(h.union(mine, 2001)) == content(merge.history_union(mine, shards, 2001))


def test_published_months_switch_together(spark, folder, monkeypatch):
    papers = "id string, published string, title string, importance long, source_type string, abstract string, categories array<string>, source_short string, source string"
    row = lambda i, day: (f"p{i}", day, f"t{i}", i, "journal", "x", ["a"], "S", "Source")
    done = spark.createDataFrame([("2024-01",), ("2024-02",)], "month string")
    root = f"{folder}/site"
    first = publish_history(spark.createDataFrame([row(i, f"2024-0{1 + i % 3}-05") for i in range(9)], papers), done, "2024-01", root)
    assert first["about"]["manifest"]["indexed_papers"] == 9 and published_papers(spark, root).count() == 9
    change = spark.createDataFrame([row(i, "2024-02-07") for i in range(20, 25)], papers)
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            publish_history(change, done, "2024-01", root)
    assert published_papers(spark, root).count() == 9
    second = publish_history(change, done, "2024-01", root)
    assert published_papers(spark, root, ["2024-02"]).count() == 5 and published_papers(spark, root).count() == 11
    assert published_papers(spark, root, version=1).count() == 9
    months, about = published_stats(spark, root)
    assert about["indexed_papers"] == 11 and {r.month: r["count"] for r in months.collect()} == {"2024-01": 3, "2024-02": 5, "2024-03": 3}
    assert second["tables"]["papers"]["2024-01"] == first["tables"]["papers"]["2024-01"]
    only = published_papers(spark, root, ["2024-01"]).inputFiles()
    assert only and all("2024-01" in f for f in only)


def test_the_first_version_computes_its_records_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    papers = spark.createDataFrame([(f"p{i}", f"Title {i}", i) for i in range(20)], "id string, title string, seq long")
    made = Catalogue(spark, f"{folder}/once", buckets=2, slices=2)
    state = made.create(papers.mapInPandas(counted, papers.schema))
    assert seen.value == 20 and made.papers().count() == made.title_log(state).count() == 20
