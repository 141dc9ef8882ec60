import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyroll.operators import jobs as J
from tallyroll.operators import predict as predict_module
from tallyroll.operators.predict import Runner, predict
from tallyroll.streaming import jobs as stream
from tallyroll.streaming import life


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # runners defined here


class Flaky(Runner):
    model_id = "flaky"

    def __init__(self):
        self.calls = {}

    def extract(self, image):
        self.calls[image] = self.calls.get(image, 0) + 1
        if image == b"never" or (image == b"later" and self.calls[image] < 3):
            raise ValueError("no")
        return image.decode()


def test_runner_is_abstract():
    with pytest.raises(TypeError):
        Runner()


def test_retries_stay_in_the_row(spark):
    df = spark.createDataFrame([(1, b"ok"), (2, b"never"), (3, b"later")], "receipt_id int, content binary")
    got = {r.receipt_id: r for r in predict(df.coalesce(1), "flaky", Flaky).collect()}
    assert got[1].raw == "ok" and got[1].error is None
    assert got[2].raw is None and got[2].error == "ValueError: no" and got[2].attempt == 4
    assert got[3].raw == "later" and got[3].attempt <= 3


class Counted(Runner):
    """Notes every build and call in files of a folder."""

    model_id = "counted"
    folder = ""

    def __init__(self):
        self._note("built")

    def _note(self, what):
        import os
        import uuid

        open(f"{type(self).folder}/{what}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def extract(self, image):
        self._note("call")
        if image == b"bad":
            raise ValueError("no")
        return image.decode()


def test_builds_and_calls(spark, tmp_path):
    """One build in each worker process, one call for each good row, all attempts for a bad one."""
    folder = str(tmp_path)

    class Here(Counted):
        pass

    Here.folder = folder
    df = spark.createDataFrame([(i, b"bad" if i == 99 else b"ok") for i in range(100)], "i int, content binary").repartition(8)
    got = predict(df, "counted", Here).collect()
    names = [p.name.split("-") for p in tmp_path.iterdir()]
    builds = [pid for what, pid, _ in names if what == "built"]
    assert len(builds) == len(set(builds))
    assert sum(what == "call" for what, *_ in names) == 99 + 4
    assert {r.i: r.attempt for r in got} == {i: 4 if i == 99 else 1 for i in range(100)}


def test_model_that_does_not_load(spark, tmp_path):
    class Broken(Echo):
        def __init__(self):
            raise RuntimeError("no weights")

    df = spark.createDataFrame([("a", b"x")], "job_id string, content binary")
    r = predict(df, "broken", Broken).first()
    assert (r.attempt, r.raw, r.error) == (0, None, "model not loaded: no weights")
    jobs = df.withColumn("content_type", F.lit("image/png"))
    assert stream.extract(jobs, "broken", Broken).first().status_code == 503


def _files(spark, df, path, *, order=None, batches=3):
    """Rows as files read one a batch: dealt at random, or in order of a column."""
    if order is None:
        df.repartition(batches).write.parquet(path)
    else:
        for part in df.select(order).distinct().orderBy(order).collect():
            df.filter(F.col(order) == part[0]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_results_are_settled(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + (i * 11) % 28:02d} 00:00:00") for i in range(60)] * 2 + [(None, "2024-01-05 00:00:00")]
    results = spark.createDataFrame(rows, "task_id int, ts string").select("task_id", F.to_timestamp("ts").alias("ts"))
    source = _files(spark, results, f"{tmp_path}/in", batches=5)
    stream.start_settling(source, f"{tmp_path}/o", f"{tmp_path}/c", buckets=4).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/o")
    assert {r.task_id for r in got.collect()} == {None, *range(60)}
    assert got.filter("task_id is not null").count() == 60


def test_only_touched_buckets_are_read(spark, tmp_path):
    """Files that cannot be read stand in every bucket that the second batch does not touch."""
    results = spark.createDataFrame([(i, 0) for i in range(40)], "task_id int, s int").select("task_id", F.timestamp_seconds("s").alias("ts"))
    out = f"{tmp_path}/o"
    results.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(results.schema).parquet(f"{tmp_path}/in")
    stream.start_settling(source(), out, f"{tmp_path}/c", buckets=8).awaitTermination()
    assert spark.read.parquet(out).count() == 40
    one = results.filter("task_id = 7 or task_id = 1000").union(spark.createDataFrame([(7,)], "task_id int").select("task_id", F.timestamp_seconds(F.lit(9))))
    touched = {r[0] for r in one.select(F.pmod(F.xxhash64("task_id"), F.lit(8))).collect()}
    for folder in (tmp_path / "o").glob("bucket=*/batch=*"):
        if int(folder.parent.name.split("=")[1]) not in touched:
            (folder / "part-broken.snappy.parquet").write_bytes(b"no parquet")
    one.write.mode("append").parquet(f"{tmp_path}/in")
    stream.start_settling(source(), out, f"{tmp_path}/c", buckets=8).awaitTermination()
    assert not list((tmp_path / "o").glob("bucket=*/batch=1"))  # task 7 was settled, and nothing else was read


def _events(spark, rows):
    df = spark.createDataFrame(rows, "event_id int, job_id int, hour double, state string")
    return df.select("event_id", "job_id", F.timestamp_millis((F.col("hour") * 3_600_000).cast("long")).alias("ts"), "state",
                     F.concat(F.lit("r"), "event_id").alias("result"), F.floor(F.col("hour") / 24).alias("day"))


@pytest.mark.parametrize("order", [None, "day"])
def test_states_expire(spark, tmp_path, order):
    """A hundred jobs, ten a day: only those of the last day keep state, folders and a visible result."""
    rows = [(i, i // 2, 2.4 * (i // 2) + (i % 2) * 0.5, ["STARTED", "SUCCESS"][i % 2]) for i in range(200)]
    events = _events(spark, rows)
    query = life.start_expiring_states(_files(spark, events, f"{tmp_path}/in", order=order).drop("day"), f"{tmp_path}/o", f"{tmp_path}/c")
    query.awaitTermination()
    newest = max(r[2] for r in rows)
    live = {r[1]: r for r in rows if r[2] > newest - 24}
    got = {r.job_id: r for r in life.live_states(spark, f"{tmp_path}/o").collect()}
    assert set(got) == set(live) and all(r.status == "done" and r.result == f"r{2 * j + 1}" for j, r in got.items())
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert state and state[-1] <= 6 * len(live)  # a value and the entries of its timer, for the jobs of a life
    if order:
        assert max(state) <= 6 * 3 * len(live)  # no more than the days between two watermarks
        assert len(list((tmp_path / "o").glob("batch=*/*.parquet"))) < 6 * 3 * 4


def test_late_events_change_no_newer_state(spark, tmp_path):
    rows = [(1, 1, 10.0, "SUCCESS"), (2, 2, 100.0, "STARTED"), (3, 1, 99.0, "RETRY"), (4, 1, 5.0, "FAILURE"), (5, 2, 99.5, "PENDING"), (6, None, 98.0, "SUCCESS")]
    events = _events(spark, rows)
    for r in (0, 1, 2, 3, 4, 5):
        events.filter(f"event_id = {r + 1}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("day")
    life.start_expiring_states(source, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    got = {(r.job_id, r.status) for r in life.live_states(spark, f"{tmp_path}/o").collect()}
    assert got == {(1, "retry"), (2, "started"), (None, "done")}


class Away(Runner):
    """Fails as often as the image says."""

    model_id = "away"

    def extract(self, image):
        return self.attempt(image, 1)

    def attempt(self, image, number):
        if number <= int(image):
            raise TimeoutError("away")
        return f"after {number}"


def test_retries_wait_their_turn(spark, tmp_path):
    """Each try in a later batch than the one before, two seconds of event time apart, four at most; nothing sleeps."""
    import inspect

    from tallyroll.operators import predict as module

    assert "sleep(" not in inspect.getsource(module) + inspect.getsource(life)
    sent = spark.createDataFrame([(i, str(i % 6), 10.0 * (i // 6)) for i in range(12)] + [(100 + i, "0", 100.0 + 10 * i) for i in range(6)], "job_id int, n string, s double").select(
        "job_id", F.encode("n", "UTF-8").alias("content"), F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"))
    source = _files(spark, sent, f"{tmp_path}/in", order="ts")
    query = life.start_retrying(source, "away", Away, f"{tmp_path}/o", f"{tmp_path}/c")
    query.awaitTermination()
    got = {}
    for r in life.tries(spark, f"{tmp_path}/o").orderBy("job_id", "attempt").collect():
        got.setdefault(r.job_id, []).append(r)
    for i in range(12):
        fails, rows = i % 6, got[i]
        assert [r.attempt for r in rows] == list(range(1, min(fails, 3) + 2))
        assert [(r.due - rows[0].due).total_seconds() for r in rows] == [2.0 * k for k in range(len(rows))]
        assert all(a.batch < b.batch for a, b in zip(rows, rows[1:]))
        assert rows[-1].raw == (f"after {fails + 1}" if fails < 4 else None) and not rows[-1].waits and all(r.waits for r in rows[:-1])
    last = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    assert last == 0  # nobody waits any more


def test_waiting_jobs_share_the_state_of_few_buckets(spark, tmp_path, monkeypatch):
    """500 jobs that wait make two timers, not 500; pieces of a list, repeated and null jobs end as they did one by one."""
    monkeypatch.setattr(life, "_HELD_ROWS", 100)
    rows = [(i, str(i % 5), 0) for i in range(500)] + [(i, "0", 1) for i in range(500)] + [(None, "2", 1), (None, "2", 1)]
    rows += [(-i, "0", 100 * i) for i in range(1, 7)]
    sent = spark.createDataFrame(rows, "job_id int, n string, s int").select(
        "job_id", F.encode("n", "UTF-8").alias("content"), F.timestamp_seconds("s").alias("ts"))
    query = life.start_retrying(_files(spark, sent, f"{tmp_path}/in", order="ts"), "away", Away, f"{tmp_path}/o", f"{tmp_path}/c", buckets=2)
    query.awaitTermination()
    got = {}
    for r in life.tries(spark, f"{tmp_path}/o").filter("job_id >= 0 OR job_id IS NULL").orderBy("job_id", "due", "attempt").collect():
        got.setdefault(r.job_id, []).append((r.attempt, r.raw, r.waits))
    for job, found in got.items():
        fails = 2 if job is None else job % 5
        once = [(k, f"after {k}" if k > fails else None, k <= fails and k < 4) for k in range(1, min(fails, 3) + 2)]
        assert found == once + [(1, "after 1", False)] * (fails == 0), job  # a repetition while a job waits changes nothing
    assert len(got) == 501
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(timers) <= 2


def test_a_timed_stream_has_files_by_its_size(spark, tmp_path):
    from tallyroll.plans import raw

    sent = spark.range(1000).select(F.col("id").alias("job_id"), F.encode(F.lit("0|x"), "UTF-8").alias("content"), F.timestamp_seconds("id").alias("ts"))
    seen = []
    stream_of = raw.timed_stream(sent, "ts", f"{tmp_path}/in", 4, 2, rows_per_file=50)
    stream_of.writeStream.foreachBatch(lambda df, _: seen.append((df.filter("job_id >= 0").count(), df.agg(F.min("ts"), F.max("ts")).first()))).option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [250] * 4 + [0] * 2
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 6 * 5
    assert all(a[1][1] < b[1][0] for a, b in zip(seen, seen[1:]))


class Half(Runner):
    """Answers in prose first; raises on some images."""

    model_id = "half"
    folder = ""

    def _note(self, what, image):
        import uuid

        open(f"{type(self).folder}/{what}-{image.decode()}-{uuid.uuid4().hex}", "w").close()

    def extract(self, image):
        self._note("extract", image)
        if int(image) % 40 == 25:
            raise RuntimeError(f"no memory for {int(image)}")
        return "prose" if int(image) % 10 == 0 else '```json\n{"n": 1}\n```' if int(image) % 10 == 1 else '{"n": 2}'

    def again(self, image, answer):
        self._note("again", image)
        return "more prose" if int(image) % 20 == 0 else '{"n": 3}'


def test_models_are_asked_again_only_where_needed(spark, tmp_path):
    class Fine(Half):
        folder = str(tmp_path)

        def extract(self, image):
            return super().extract(image) if int(image) % 40 != 25 else "{}"

    samples = spark.createDataFrame([(i, str(i).encode()) for i in range(100)], "at int, content binary").repartition(4)
    rows = {r.at: r for r in predict_module.run_models(samples, {"fine": Fine}, "at").collect()}
    assert {i: r.asked for i, r in rows.items()} == {i: 2 if i % 10 == 0 else 1 for i in range(100)}
    assert rows[0].payload == "{}" and rows[10].payload == '{"n": 3}' and rows[1].payload == '{"n": 1}' and rows[25].payload == "{}"
    calls = [p.name.split("-")[:2] for p in tmp_path.iterdir()]
    assert sorted(n for what, n in calls if what == "again") == sorted(str(i) for i in range(0, 100, 10))
    assert sum(what == "extract" for what, _ in calls) == 98


def test_first_failure_of_a_run(spark, tmp_path):
    """A model that cannot be built, one that raises, one that answers; the first failing sample by order is told."""
    class Noted(Half):
        folder = str(tmp_path)

    class NoKey(Half):
        def __init__(self):
            raise EnvironmentError("no key")

    class NoFile(Half):
        def __init__(self):
            raise ValueError("bad weights")

    registry = {"noted": Noted, "no-key": NoKey, "no-file": NoFile, "echo": Echo}
    samples = spark.createDataFrame([(i, str(i).encode()) for i in reversed(range(400))], "at int, content binary").repartition(3)
    answered = predict_module.run_models(samples, registry, "at").cache()
    assert answered.count() == 1600
    why = {r.model_id: (r.load_reason, r.error) for r in predict_module.first_failures(answered, "at").collect()}
    assert why == {"noted": (None, "no memory for 25"), "no-key": ("no key", None), "no-file": ("load error: bad weights", None), "echo": (None, None)}
    assert answered.filter("model_id = 'echo' and payload = '{}'").count() == 400  # numbers are no objects
    empty = predict_module.run_models(samples.limit(0), registry, "at")
    assert empty.collect() == [] and predict_module.first_failures(empty, "at").collect() == []


def test_is_object_agrees_with_the_parser(spark):
    from tallyroll.functions.responses import parse_response

    texts = ['{}', ' {"a": 1} ', '[1]', '"x"', '1', 'null', '', ' ', 'prose {"a": 1}', '{"a": 1} tail', '```json\n{"a": 1}\n```', '```\n{"a": 1}',
             '```\n{"a": 1}\n``` \n', '```', '{"a": NaN}', '{"a": 1, "a": 2}', "{'a': 1}", '{"a": 01}', '{"a": "é\\u00e9"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", parse_response(F.col("t"))["status"])
    assert [(r.t, r.s == "ok") for r in df.collect()] == [(t, predict_module.is_object(t)) for t in texts]
    assert not predict_module.is_object(None)


def test_images_to_tables(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    body = b'{"menu":{"nm":"Tea","price":"5"},"sub_total":{"storenm":"S"},"total":{"total_price":"5"}}'
    for name, content in {"a.jpg": body, "b.png": b"no json", "c.txt": body}.items():
        (inbox / name).write_bytes(content)
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"

    def run():
        arriving = stream.submissions(spark, str(inbox))
        stream.start_extraction(arriving, "echo", Echo, out, ckpt).awaitTermination()
        rows = stream.extraction_results(spark, out).select("status_code", "valid").collect()
        return sorted((r.status_code, str(r.valid).lower()) for r in rows)

    assert run() == [(200, "true"), (415, "false"), (500, "false")]
    (inbox / "d.jpeg").write_bytes(body)
    assert run() == [(200, "true"), (200, "true"), (415, "false"), (500, "false")]


class Echo(Runner):
    model_id = "echo"

    def extract(self, image):
        return image.decode()


def test_states_and_dedupe(spark, tmp_path):
    rows = [(i, i % 4, i, ["PENDING", "STARTED", "SUCCESS", "FAILURE"][(i * 7) % 4]) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id int, job_id int, s int, state string").select(
        "event_id", "job_id", F.timestamp_seconds("s").alias("ts"), "state", F.lit("r").alias("result")
    )
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.start_job_states(source, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    got = sorted(map(tuple, stream.current_states(spark, f"{tmp_path}/o").collect()))
    want = sorted(map(tuple, J.latest_state(events).collect()))
    assert len(got) == 4 and got == want

    results = events.select(F.col("job_id").alias("task_id"), "ts")
    results.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/r")
    again = spark.readStream.schema(results.schema).parquet(f"{tmp_path}/r")
    stream.start_append(stream.dedupe_results(again), f"{tmp_path}/d", f"{tmp_path}/dc").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/d").count() == 4 == J.first_result(results).count()


def test_retry_fallback(spark):
    rows = [(1, 1, "invalid", "{}"), (1, 2, "ok", "b"), (1, 3, "ok", "c"), (2, 1, "invalid", "{}"), (3, 1, "ok", "a")]
    df = spark.createDataFrame(rows, "k int, attempt int, status string, payload string")
    got = {r.k: (r.payload, r.parse_status, r.retried) for r in J.retry_fallback(df, "k").collect()}
    assert got == {1: ("b", "ok", True), 2: ("{}", "failed", True), 3: ("a", "ok", False)}


def test_a_batch_of_files_is_looked_up_by_few_tasks(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(300):
        (inbox / f"{i}.png").write_bytes(b"x")
    status, before = spark.sparkContext.statusTracker(), spark.conf.get(stream._LISTING_TASKS)
    seen = set(status.getJobIdsForGroup())
    with stream.few_listing_tasks(spark):
        query = stream.start_append(stream.submissions(spark, str(inbox)), f"{tmp_path}/out", f"{tmp_path}/ckpt")
        query.awaitTermination()
    jobs = set(status.getJobIdsForGroup(str(query.runId))) - seen
    tasks = [status.getStageInfo(s).numTasks for j in jobs for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert tasks and max(tasks) < 300 and spark.read.parquet(f"{tmp_path}/out").count() == 300
    assert spark.conf.get(stream._LISTING_TASKS) == before
