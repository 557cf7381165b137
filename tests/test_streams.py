import json
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from growthlens.operators import answers
from growthlens.sources import landed
from growthlens.streaming import jobs


def write_events(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(folder))


def test_funnel_steps_in_any_order_of_arrival(spark, tmp_path):
    rows = [
        (1, "2024-01-01 00:00:00", 1, "view", 1.0, "{}"), (2, "2024-01-01 00:01:00", 1, "click", 1.0, "{}"),
        (3, "2024-01-01 00:00:30", 2, "click", 1.0, "{}"), (4, "2024-01-01 00:02:00", 1, "signup", 1.0, "{}"),
        (5, "2024-01-01 00:00:40.000001", 3, "view", 1.0, "{}"), (6, "2024-01-01 00:00:40.000002", 3, "click", 1.0, "{}"),
        (7, "2024-01-01 00:00:40.000002", 3, "signup", 1.0, "{}"), (8, "2024-01-01 00:00:40.000002", 3, "click", 1.0, "{}"),
    ]
    for row in reversed(rows):
        write_events(spark, tmp_path / "e", [row])
    job = lambda e: jobs.funnel_state(e, ["view", "click", "signup"])
    out = jobs.run_bounded(spark, str(tmp_path / "e"), job, "*.parquet", jobs.ROCKS)
    assert sorted((r.user_id, r.steps_done, r.last_us % 10) for r in out.collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (3, 2, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_repeated_steps_of_a_funnel(spark, tmp_path):
    write_events(spark, tmp_path / "e", [(i, f"2024-01-01 00:0{i}:00", 1, "view", 1.0, "{}") for i in range(3)])
    out = jobs.run_bounded(spark, str(tmp_path / "e"), lambda e: jobs.funnel_state(e, ["view", "view", "view", "click"]), "*.parquet", jobs.ROCKS)
    assert out.agg(F.max("steps_done")).first()[0] == 3


class CountedState:
    """Stands for the state store of one user and counts the calls to it."""

    def __init__(self):
        self.calls, self.value, self.entries, self.timers = 0, None, [], set()

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.did(self.value), update=lambda v: self.did(setattr(self, "value", v)))

    def getListState(self, *_):
        put = lambda v: self.did(setattr(self, "entries", [*v]))
        return SimpleNamespace(get=lambda: iter(self.did([*self.entries])), appendValue=lambda v: self.did(self.entries.append(v)), put=put, clear=lambda: put([]))

    def registerTimer(self, ms):
        self.did(self.timers.add(ms))

    def deleteTimer(self, ms):
        self.did(self.timers.remove(ms))

    def did(self, result):
        self.calls += 1
        return result


def test_funnel_state_is_called_per_batch_and_not_per_row():
    state, steps = CountedState(), jobs.FunnelSteps(3)
    steps.init(state)
    rows = [(i * 1000 + 7, 1 << (i // 5000)) for i in range(15000)]
    for part in (rows[9000:], rows[:9000]):  # the later ones arrive first
        assert not [*steps.handleInputRows((1,), iter([Row(us=us, mark=m) for us, m in [*part, (5, 0)]]), None)]
    assert state.timers == {1} and state.calls < 12

    def expire(watermark):
        due = min(state.timers)
        out = [(r.steps_done, r.last_us) for r in steps.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None)]
        state.timers.discard(due)
        return out

    assert expire(6000) == [(1, 7), (2, 5000007)] and state.timers == {6001}
    assert expire(10**9) == [(3, 10000007)] and not state.timers and not state.entries and state.calls < 24


def test_late_rows_are_counted(spark, tmp_path):
    base = str(tmp_path / "e")
    stream = lambda: jobs.daily_counts(jobs.read_events(spark, base, "*.parquet"))
    write_events(spark, base, [(1, "2024-01-05 00:00:00", 1, "view", 1.0, "{}"), (2, "2024-01-03 00:00:00", 1, "view", 2.0, "{}")])
    out = str(tmp_path / "o")
    first, _ = jobs.run_available(stream(), out)
    assert [(str(r.day), r.n) for r in first.collect()] == [("2024-01-03", 1)]
    write_events(spark, base, [(3, "2024-01-03 01:00:00", 1, "view", 5.0, "{}")])
    again, query = jobs.run_available(stream(), out)
    assert again.count() == 1 and jobs.late_rows(query) == 1


def test_mentions_equal_their_batch_twin(spark, tmp_path):
    lines = [
        {"ts": f"2024-01-0{1 + i % 3}T00:00:00Z", "engine": f"e{i % 2}", "prompt_id": "p", "kind": "k", "run": 1, "error": "x" if i == 4 else None,
         "answer": "Acme wins" if i % 2 else "none", "cited_urls": ["https://www.acme.com/"] if i % 3 else [], "cost_usd": 0.001}
        for i in range(12)
    ]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    path = str(tmp_path / "log")
    got, _ = jobs.run_available(jobs.mentions(landed.stream_ai_log(spark, path), ["Acme"], [], ["acme.com"]))
    batch = answers.analyze(landed.read_ai_log(spark, path), ["Acme"], [], ["acme.com"])
    twin = {}
    for day in ("2024-01-01",):  # the only day the watermark has closed
        for r in answers.engine_summary(batch.filter(F.to_date("ts") == day)).collect():
            twin[day, r.engine] = (r.calls, r.mention_rate, r.citation_rate)
    assert {(str(r.day), r.engine): (r.calls, r.mention_rate, r.citation_rate) for r in got.collect()} == twin
    assert str(answers.engine_summary(batch).filter("engine = 'e0'").first().cost_usd) == "0.006000"


def test_enrich_is_a_left_join(spark, tmp_path):
    static = spark.createDataFrame([("s", "Acme")], "site string, brand string")
    log = spark.createDataFrame([("s", 1), ("t", 2)], "site string, n int")
    assert sorted((r.site, r.brand) for r in jobs.enrich(log, static).collect()) == [("s", "Acme"), ("t", None)]


def test_folder_of_files_equals_the_batch_jobs(spark, tmp_path):
    """A table of eight part files in arbitrary order, read as a stream to its end, gives what the batch jobs give."""
    from growthlens import catalog
    from growthlens.operators import web

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    paged = events.withColumn("page", F.concat(F.lit("/page/"), F.col("event_id") % 40))
    steps = ["view", "click", "signup", "purchase"]
    day = F.to_date("ts").alias("day")
    twins = {
        "stream_daily_counts": events.groupBy(day, "event_type").agg(F.count("*"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)")),
        "stream_dedupe": events.select("user_id", "event_type", "props").distinct(),
        "rt_active_users": web.active_users(paged).select("window_start", "page", "active_users"),
        "stream_funnel": web.funnel(events, steps),
    }
    for name, twin in twins.items():
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, twin.collect())) and got, name
    got = catalog.queries()["stream_sessions"](spark, str(tmp_path))
    assert got.agg(F.sum("n_events")).first()[0] == events.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.queries()["stream_sessions"](spark, "/root/testdata/sf0.001").collect()))
