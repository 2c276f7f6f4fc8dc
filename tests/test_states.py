"""Stateful streams across restarts, and two writers of the job table."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from slateledger.operators import records
from slateledger.sources.jobtable import Conflict, JobTable
from slateledger.streaming import states


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.STORE)


def drop(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(spark, tmp, source, fn, schema):
    """One availableNow run from the checkpoint; what it gave."""
    out = []
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = fn(src).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return out


def test_trigger_goes_on_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    files = lambda n, name="a": [{"name": name, "kind": "file"}] * n
    go = lambda: [(r.name, r["count"], r.started) for r in run(spark, tmp_path, source, lambda s: states.triggers(s, 5), "name string, kind string")]
    drop(source, "0", files(4) + files(7, "b"))
    assert go() == [("b", 5, True)]
    drop(source, "1", files(2))  # the fifth file after the restart
    assert go() == [("a", 5, True)]
    drop(source, "2", files(10))  # two more multiples while the training runs
    assert sorted(go()) == [("a", 10, False), ("a", 15, False)]
    drop(source, "3", [{"name": "a", "kind": "done"}] + files(9))
    assert sorted(go()) == [("a", 20, True), ("a", 25, False)]


def test_jobs_keep_their_state_and_time_out(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = lambda j, m, s, p=0: {"job_id": j, "ts": f"2024-01-01T00:{m:02d}:00Z", "status": s, "percent": p, "message": "m"}
    schema = "job_id string, ts timestamp, status string, percent int, message string"
    go = lambda: {(r.job_id, r.status, r.percent, r.message) for r in run(spark, tmp_path, source, lambda s: states.job_states(s, 10 * 60_000, "1 minute"), schema)}
    drop(source, "0", [at("x", 1, "queued"), at("y", 1, "processing", 10), at("z", 2, "complete", 100), at("z", 3, "processing", 50), at("z", 1, "odd")])
    assert go() == {("x", "queued", 0, "m"), ("y", "processing", 10, "m"), ("z", "complete", 100, "m")}
    drop(source, "1", [at("x", 9, "processing", 40), at("z", 4, "failed")])
    assert go() == {("x", "processing", 40, "m")}
    drop(source, "2", [at("w", 15, "queued")])  # y's deadline is minute 11, x's 19
    drop(source, "3", [at("w", 16, "queued", 1)])
    got = go()
    assert ("y", "failed", 10, "timed out") in got and not any(j == "x" for j, *_ in got)


def test_states_don_t_depend_on_order():
    t = lambda m: m * 60_000_000
    a, b, c, d = (t(1), "queued", 0, "m"), (t(5), "failed", 3, "m"), (t(9), "processing", 9, "m"), (t(7), "complete", 100, "m")
    import itertools

    for order in itertools.permutations([a, b, c, d]):
        held = None
        for s in order:
            held = states.further(held, s)
        assert held == b
    assert states.further(states.further(None, c), a) == c


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both merge into the same table at once; readers in between see whole snapshots only."""
    path = str(tmp_path / "jobs")
    JobTable(spark, path).merge(spark.range(40).select(F.col("id").alias("job_id"), F.lit("queued").alias("status")))
    seen, failed = [], []

    def write(k):
        try:
            for i in range(4):
                one = spark.range(40).where(f"id % 4 = {i}").select(F.col("id").alias("job_id"), F.lit(f"w{k}-{i}").alias(f"by{k}"))
                JobTable(spark, path).merge(one)
                seen.append(JobTable(spark, path).read()[1].count())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    version, rows = JobTable(spark, path).read()
    assert not failed and version == 9 and set(seen) == {40}
    assert all((r.by1, r.by2, r.revision, r.status) == (f"w1-{r.job_id % 4}", f"w2-{r.job_id % 4}", 3, "queued") for r in rows.collect())
    table = JobTable(spark, path)
    table.vacuum(keep=1)
    assert table.versions() == [9] and table.read()[1].count() == 40


def test_conflicts_and_odd_changes(spark, tmp_path):
    table = JobTable(spark, str(tmp_path / "jobs"))
    assert table.read() == (0, None)
    table.merge(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "x")], "job_id long, status string"))
    old = table.read()[1]
    table.merge(spark.createDataFrame([(1, "later"), (3, "new")], "job_id long, status string"))
    with pytest.raises(Conflict):
        table.merge(old.where("job_id = 1").withColumn("status", F.lit("stale")))
    table.merge(old.where("job_id = 2").withColumn("status", F.lit(None).cast("string")))  # null sets nothing
    table.merge(old.limit(0))
    assert sorted((r.job_id, r.status, r.revision) for r in table.read()[1].collect()) == [(1, "later", 2), (2, "b", 2), (3, "new", 1)]
    assert table.read(1)[1].count() == 2
    assert not table._commit(table.versions()[-1], "data/none", "job_id long")


def test_shared_folder(spark, monkeypatch):
    assert records.own_folder(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))
