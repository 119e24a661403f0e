"""Tables that cut lineage, in the shared folder of the cluster.

Every iterative operator writes its intermediate results here instead of keeping
them in executor memory, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from folio.llm.recent import give_back, small_batches
from folio.shared import shared_dir


class Scratch:
    """Parquet tables of one operator run, dropped when they are no longer needed."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{name}-{self.n}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        give_back()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folio_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables. Shuffle files of plans that are gone go with the driver's next collection, so that is asked for too."""
        for df in frames:
            self.delete(df._folio_path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
