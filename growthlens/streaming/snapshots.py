"""Issue changes of snapshots that arrive in parts.

Issue rows of many sites land in any number of micro-batches. A snapshot of a site is complete when as many rows have
landed as its marker says (a row without a code that carries ``n_issues``; it may land first or last, and is what a
snapshot without issues consists of). Snapshots of a site are compared in their order, each with the one compared
before it, so one that is still incomplete holds back later ones of its own site only.

The state lies in three tables under one folder, all written per batch and so the same after a replay:

* ``rows``: landed issues by snapshot and batch. Nothing is rewritten; a comparison reads the folders of its two
  snapshots only.
* ``ledger``: one row per site that a batch touched: the snapshot compared last and those that are open with their
  counts. The latest row of a site holds; every ``FOLD`` batches one row per site is folded together.
* ``summary`` and ``changes``: the results.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import changes

#: Batches between two foldings of the ledger.
FOLD = 50
ISSUES = "site string, snapshot string, code string, url string, severity string, crawl_pos bigint, n_issues bigint"
_OPEN = "array<struct<snapshot:string,landed:bigint,expected:bigint>>"
_LEDGER = f"site string, compared string, open {_OPEN}"
SUMMARY = "site string, snapshot string, before string, n_new bigint, n_resolved bigint, n_persisting bigint, n_new_high bigint, n_current bigint"
CHANGES = "site string, snapshot string, before string, change string, code string, url_key string, url string, severity string, crawl_pos bigint"


def with_markers(issues: DataFrame) -> DataFrame:
    """Rows of (site, snapshot, code, url, severity, crawl_pos) with one marker per snapshot that counts them."""
    marks = issues.groupBy("site", "snapshot").agg(F.count("*").alias("n_issues"))
    return issues.unionByName(marks, allowMissingColumns=True).select(*[f.split()[0] for f in ISSUES.split(", ")])


class IssueChanges:
    """``foreachBatch`` function over rows of ``ISSUES``; results by ``summary()`` and ``changes()``.

    Rows without a site or a snapshot cannot be assigned and are left out. Rows of one page and code within a snapshot
    count as one issue, as in ``operators.changes``. More rows than a marker says complete a snapshot as well; rows of a
    snapshot that has been compared change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # ------------------------------------------------------------- state

    def _batches(self, table: str) -> list[int]:
        """Batches that a table has, from its folder names."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        store = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(base):
            return []
        names = [s.getPath().getName() for s in store.listStatus(base)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def _read(self, table: str, schema: str, batches: Iterable[int]) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)
        return found.select(*T._parse_datatype_string(schema).names)

    def _ledger(self, before: int) -> DataFrame:
        """Latest row per site of the batches below ``before``."""
        folds = [b for b in self._batches("folded") if b < before]
        since = folds[-1] if folds else -1
        rows = self._read("ledger", f"{_LEDGER}, batch bigint", [b for b in self._batches("ledger") if since < b < before])
        if folds:
            rows = rows.unionByName(self._read("folded", f"{_LEDGER}, batch bigint", folds[-1:]))
        last = rows.groupBy("site").agg(F.max_by(F.struct("compared", "open"), "batch").alias("s"))
        return last.select("site", "s.compared", "s.open")

    def _rows(self, snapshots: list[str], upto: int) -> DataFrame:
        paths = [f"{self.folder}/rows/snapshot={_escaped(s)}" for s in snapshots]
        paths = [p for p in paths if self._there(p)]
        schema = ISSUES.removesuffix(", n_issues bigint") + ", batch bigint"
        if not paths:
            return self.spark.createDataFrame([], schema).drop("batch")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(*paths)
        return rows.filter(F.col("batch") <= upto).drop("batch")

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    # ------------------------------------------------------------- one batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.spark
        landed = batch.filter("site IS NOT NULL AND snapshot IS NOT NULL")
        counts = landed.groupBy("site", "snapshot").agg(F.count("code").alias("landed"), F.max("n_issues").alias("expected"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch_id}")
        counts = self._read("counts", "site string, snapshot string, landed bigint, expected bigint", [batch_id])

        sites = counts.select("site").distinct()
        known = self._ledger(batch_id).join(sites, "site", "left_semi")
        # rows of a snapshot that has been compared come too late, and are not kept
        issues = landed.filter("code IS NOT NULL").drop("n_issues").join(known.select("site", "compared"), "site", "left")
        issues = issues.filter("compared IS NULL OR snapshot > compared").drop("compared").withColumn("batch", F.lit(batch_id))
        (issues.write.partitionBy("snapshot", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .parquet(f"{self.folder}/rows"))
        still = known.select("site", F.inline("open")).unionByName(counts)
        still = still.groupBy("site", "snapshot").agg(F.sum("landed").alias("landed"), F.max("expected").alias("expected"))
        still = still.join(known.select("site", "compared"), "site", "left").filter("compared IS NULL OR snapshot > compared")
        whole = F.coalesce(F.col("landed") >= F.col("expected"), F.lit(False))
        along = Window.partitionBy("site").orderBy("snapshot")  # the open snapshots of one site
        still = still.withColumn("held", F.max(~whole).over(along)).withColumn("before", F.coalesce(F.lag("snapshot").over(along), "compared"))
        still.write.mode("overwrite").parquet(f"{self.folder}/open/batch={batch_id}")
        still = spark.read.schema(still.schema).parquet(f"{self.folder}/open/batch={batch_id}")

        ready = still.filter("NOT held").select("site", "snapshot", "before")
        self._compare(ready, batch_id)
        state = still.groupBy("site").agg(
            F.max(F.when(~F.col("held"), F.col("snapshot"))).alias("now"), F.max("compared").alias("compared"),
            F.collect_list(F.when(F.col("held"), F.struct("snapshot", "landed", "expected"))).alias("open"),
        )
        # sites whose rows were all late have nothing open and keep what they had
        state = sites.join(known, "site", "left").select("site", F.col("compared").alias("was")).join(state, "site", "left")
        state = state.select("site", F.coalesce("now", "compared", "was").alias("compared"), F.coalesce("open", F.array().cast(_OPEN)).cast(_OPEN).alias("open"))
        state.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch_id}")
        if batch_id % FOLD == FOLD - 1:
            self._ledger(batch_id + 1).write.mode("overwrite").parquet(f"{self.folder}/folded/batch={batch_id}")

    def _compare(self, ready: DataFrame, batch_id: int) -> None:
        # a handful of snapshot names, not sites
        names = ready.select(F.explode(F.array("snapshot", "before")).alias("s")).filter("s IS NOT NULL").distinct()
        rows = self._rows([r.s for r in names.collect()], batch_id)
        curr = rows.join(ready, ["site", "snapshot"])
        prev = rows.withColumnRenamed("snapshot", "before").join(ready.filter("before IS NOT NULL"), ["site", "before"])
        # a site stands in a comparison once per snapshot, so the two together are what a site is to a single comparison
        name = F.to_json(F.struct("site", "snapshot", "before")).alias("site")
        prev, curr = (d.select(name, "code", "url", "severity", "crawl_pos") for d in (prev, curr))
        parts = F.from_json("site", "site string, snapshot string, before string")
        unpacked = [parts[c].alias(c) for c in ("site", "snapshot", "before")]
        counted = changes.issue_changes(prev, curr)
        counted = ready.select(name).join(counted, "site", "left").na.fill(0)  # a snapshot without issues after one without
        counted.select(*unpacked, *counted.columns[1:]).write.mode("overwrite").parquet(f"{self.folder}/summary/batch={batch_id}")
        new = changes.issues_new(prev, curr).withColumn("change", F.lit("new"))
        gone = changes.issues_resolved(prev, curr).withColumn("change", F.lit("resolved"))
        out = new.unionByName(gone).select(*unpacked, "change", "code", "url_key", "url", "severity", "crawl_pos")
        out.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")

    # ------------------------------------------------------------- results

    def summary(self) -> DataFrame:
        """New, resolved, persisting, new high and current issues of every snapshot that has been compared."""
        return self._read("summary", SUMMARY, self._batches("summary"))

    def changes(self) -> DataFrame:
        """The new and the resolved issues themselves."""
        return self._read("changes", CHANGES, self._batches("changes"))

    def open_snapshots(self) -> DataFrame:
        """Snapshots that wait for rows, for their marker, or for an earlier one."""
        return self._ledger(2**62).select("site", "compared", F.inline("open"))

    def run(self, landed: DataFrame, checkpoint: str) -> None:
        """Take in everything that has landed on a stream of ``ISSUES``."""
        query = landed.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def _escaped(value: str) -> str:
    """A partition value as a folder name, written as Spark writes it."""
    special = set('"#%\'*/:=?\\{[]^\x7f') | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in value) or "__HIVE_DEFAULT_PARTITION__"
