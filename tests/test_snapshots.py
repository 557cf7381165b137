"""Snapshots that arrive in parts, out of order, twice, without issues, for many sites."""

import random

import pytest
from pyspark.sql import functions as F

from growthlens.operators import changes
from growthlens.streaming import snapshots
from growthlens.streaming.snapshots import IssueChanges


@pytest.fixture
def rows(spark):
    return lambda *r: spark.createDataFrame(list(r), snapshots.ISSUES)


def issue(site, snapshot, n, severity="high"):
    return (site, snapshot, "c", f"https://a/{n}", severity, n, None)


def mark(site, snapshot, n):
    return (site, snapshot, None, None, None, None, n)


def told(job):
    return {(r.site, r.snapshot): (r.before, r.n_new, r.n_resolved, r.n_persisting, r.n_new_high, r.n_current) for r in job.summary().collect()}


def test_a_snapshot_in_two_batches_is_one(spark, tmp_path, rows):
    job = IssueChanges(spark, str(tmp_path))
    job(rows(issue("s", "1", 1), issue("s", "1", 2), mark("s", "1", 3)), 0)
    assert told(job) == {} and [(r.landed, r.expected) for r in job.open_snapshots().collect()] == [(2, 3)]
    job(rows(issue("s", "1", 3), issue("s", "2", 2), (None, "2", "c", "u", "low", 1, None)), 1)
    assert told(job) == {("s", "1"): (None, 3, 0, 0, 3, 3)}
    job(rows(mark("s", "2", 2), issue("s", "2", 4, "low")), 2)
    want = told(job)
    assert want["s", "2"] == ("1", 1, 2, 1, 0, 2)
    job(rows(mark("s", "2", 2), issue("s", "2", 4, "low")), 2)  # a replay changes nothing
    assert told(job) == want
    job(rows(issue("s", "2", 9), mark("s", "3", 0)), 3)  # late rows change nothing; a snapshot without issues counts
    assert told(job) == want | {("s", "3"): ("2", 0, 2, 0, 0, 0)}
    got = {(r.snapshot, r.change, r.url) for r in job.changes().filter("snapshot > '1'").collect()}
    assert got == {("2", "new", "https://a/4"), ("2", "resolved", "https://a/1"), ("2", "resolved", "https://a/3"),
                   ("3", "resolved", "https://a/2"), ("3", "resolved", "https://a/4")}


def test_an_incomplete_snapshot_holds_back_its_own_site_only(spark, tmp_path, rows):
    job = IssueChanges(spark, str(tmp_path))
    job(rows(issue("a", "1", 1), mark("a", "2", 1), issue("a", "2", 1), mark("b", "1", 1), issue("b", "1", 1)), 0)
    assert set(told(job)) == {("b", "1")}
    job(rows(mark("a", "1", 1)), 1)
    assert told(job)["a", "2"] == ("1", 0, 0, 1, 0, 1) and job.open_snapshots().count() == 0


def test_any_split_gives_what_whole_snapshots_give(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FOLD", 2)
    rng = random.Random(3)
    days = ["2026-10-01", "2026-10-08 12:30", "2026-10-15"]
    rows = [
        (f"s{s}", d, rng.choice("cd"), f"https://x/{rng.randrange(9)}", rng.choice(["high", "low"]), k)
        for s in range(6) for d in days for k in range(rng.randrange(1, 12))
    ]
    all_ = spark.createDataFrame(rows, "site string, snapshot string, code string, url string, severity string, crawl_pos bigint")
    landed = snapshots.with_markers(all_)
    landed.repartition(8, F.rand(1)).write.parquet(f"{tmp_path}/landed")
    job = IssueChanges(spark, f"{tmp_path}/state")
    job.run(spark.readStream.schema(snapshots.ISSUES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landed"), f"{tmp_path}/c")
    assert job.open_snapshots().count() == 0 and len(job._batches("folded")) >= 2
    got = {(r.site, r.snapshot): (r.n_new, r.n_resolved, r.n_persisting, r.n_new_high, r.n_current) for r in job.summary().collect()}
    want = {}
    for before, now in zip([None, *days], days):
        prev, curr = all_.filter(F.col("snapshot") == F.lit(before)), all_.filter(F.col("snapshot") == now)
        want |= {(r.site, now): (r.n_new, r.n_resolved, r.n_persisting, r.n_new_high, r.n_current) for r in changes.issue_changes(prev, curr).collect()}
    assert got == want and len(got) == 18
