"""A durable ledger of experiments: what a search has finished is read back, not done again.

Each experiment lies under a key of its settings, as a folder of predictions and one of metrics. A
folder counts once Spark has committed it (the success marker is written last), so a job that was
killed leaves nothing that looks finished, and the search takes up where it was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the marker that Spark's writers leave behind a finished job.
COMMITTED = "_SUCCESS"


def settings_key(settings: dict) -> str:
    """A folder name that depends on the settings and not on their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:32]


@dataclass
class Store:
    """Experiments and ledgers below ``root``, a folder all nodes share.

    One store is for one set of windows: the settings do not tell other data apart.
    ``computed`` and ``reused`` name the folders written and found by this object.
    """

    spark: SparkSession
    root: str
    computed: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def committed(self, *parts: str) -> bool:
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts, COMMITTED))
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def table(self, parts: tuple[str, ...], compute: Callable[[], DataFrame]) -> DataFrame:
        """The committed table of that name, which ``compute`` gives if there is none yet."""
        name = "/".join(parts)
        if self.committed(*parts):
            self.reused.append(name)
        else:
            # what an unfinished job has left is overwritten
            compute().write.mode("overwrite").parquet(self.path(*parts))
            self.computed.append(name)
        return self.spark.read.parquet(self.path(*parts))

    def predictions(self) -> DataFrame:
        """Window predictions of all finished experiments, with the experiment's ``key``."""
        return self._all("predictions")

    def metrics(self) -> DataFrame:
        return self._all("metrics")

    def _all(self, kind: str) -> DataFrame:
        found = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        rows = found.parquet(f"{self.path('experiments')}/*/{kind}*")
        key = F.regexp_extract(F.input_file_name(), r"/experiments/([^/]+)/", 1)
        return rows.withColumn("key", key)
