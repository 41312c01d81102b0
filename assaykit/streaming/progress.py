"""Progress of streaming queries as a table."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

ROW = "query string, run string, batch long, rows long, per_second double, metric string, value double"


class ProgressTable(StreamingQueryListener):
    """Writes a small JSON file for each batch of each query: its rows, its speed, and each observed metric.

    A file is written hidden and renamed, so readers find whole ones only. Files are named by run and batch, so a batch
    that is told twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ended: dict[str, threading.Event] = {}

    def _write(self, name: str, rows: list[dict]) -> None:
        jvm = self.spark._jvm
        at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        store = at("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = store.create(at(f".{name}"), True)
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        out.close()
        store.rename(at(f".{name}"), at(name))

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        base = {"query": p.name, "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond}
        metrics = {f"{group}.{k}": v for group, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        self._write(f"{p.runId}-{p.batchId:09d}.json", [base | {"metric": None, "value": None}] + [base | {"metric": k, "value": None if v is None else float(v)} for k, v in metrics.items()])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, run: str, seconds: float = 60) -> None:
        """Until all of a run that has ended was told."""
        if not self.ended.setdefault(str(run), threading.Event()).wait(seconds):
            raise TimeoutError(f"run {run} didn't end")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows that were told so far: one for each batch, and one for each of its metrics."""
    return spark.read.schema(ROW).json(path)
