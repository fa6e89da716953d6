"""Mart sink: month-partitioned parquet, published by manifest.

A run writes its months into a folder of its own (``runs/run=<id>/start_interval=<month>``), which no reader looks at.  It then publishes
a manifest, the next file of ``manifests/``, that maps every month to the run that holds it: months of the run point to it, months that it
covers without a row go, all others stay as they were.  The manifest appears by a rename that fails where the name is taken, so
a reader sees a run whole or not at all, a run that dies leaves the months as they were, and of two runs that publish at once the
second merges into the manifest of the first.  The mart is computed once.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class _Store:
    """Small files of a mart folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create a file whole; False if the name is taken."""
        staged = self.path(f"staged/{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        out.write(text.encode())
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.gateway.new_array(kinds, 0)
        try:
            self.context.rename(staged, self.path(name), none)
            return True
        except Exception:  # the rename's own errors arrive as Java exceptions of several kinds
            if not self.fs.exists(self.path(name)):
                raise
            self.fs.delete(staged, False)
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _latest(store: _Store) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 and an empty one if there is none."""
    versions = [int(n[1:-5]) for n in store.names("manifests") if n.startswith("v") and n.endswith(".json")]
    if not versions:
        return 0, {"months": {}, "schema": None}
    return max(versions), json.loads(store.read(f"manifests/v{max(versions):012d}.json"))


def write_mart(df: DataFrame, path: str, period_col: str = "start_interval", months: Iterable[dt.date] | None = None) -> str:
    """Write ``df`` by month and publish it; returns the run's id.

    ``months``: the months that this run covers; of these, those that ``df`` has no row for are emptied, so that a re-run leaves
    no stale rows.  Rows are rebalanced by month: small months end in one file each, a large one is split by size.
    """
    store, run = _Store(df.sparkSession, path), uuid.uuid4().hex
    df.hint("rebalance", period_col).write.partitionBy(period_col).parquet(f"{store.root}/runs/run={run}")
    prefix = f"{period_col}="
    filled = [n[len(prefix):] for n in store.names(f"runs/run={run}") if n.startswith(prefix)]
    covered = {m.isoformat() for m in months or ()}
    while True:
        version, seen = _latest(store)
        kept = {m: r for m, r in seen["months"].items() if m not in covered}
        merged = {"months": kept | dict.fromkeys(filled, run), "schema": df.schema.jsonValue(), "period": period_col}
        if store.publish(f"manifests/v{version + 1:012d}.json", json.dumps(merged)):
            return run


def read_mart(spark: SparkSession, path: str, months: list | None = None, period_col: str = "start_interval") -> DataFrame:
    """The published rows; ``months`` reads those partitions only."""
    store = _Store(spark, path)
    _, seen = _latest(store)
    if seen["schema"] is None:
        raise FileNotFoundError(f"no published mart in {path}")
    schema = StructType.fromJson(seen["schema"])
    wanted = {m.isoformat() for m in months} if months else None
    folders = [f"{store.root}/runs/run={r}/{period_col}={m}" for m, r in sorted(seen["months"].items()) if wanted is None or m in wanted]
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", f"{store.root}/runs").parquet(*folders)
    return df.select(*[F.col(f"`{c}`") for c in schema.names])


def vacuum_mart(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete runs that none of the last ``keep`` manifests names, and older manifests; returns the runs deleted.

    Call it when no run is being written: a run that isn't published yet looks like a dead one.
    """
    store = _Store(spark, path)
    names = store.names("manifests")
    live = {r for n in names[-keep:] for r in json.loads(store.read(f"manifests/{n}"))["months"].values()}
    dead = [n[4:] for n in store.names("runs") if n.startswith("run=") and n[4:] not in live]
    for r in dead:
        store.delete(f"runs/run={r}")
    for n in names[:-keep]:
        store.delete(f"manifests/{n}")
    return dead
