"""Results by content key, kept between runs: what was computed once for a content is read, not computed again.

Each run appends the results of its new contents to a folder of its own, in parts by a hash of the key, and a row in `runs`,
written last, makes them visible. A run reads only the parts its keys lie in. A run that fails leaves nothing visible, and
its contents are computed by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_key


@dataclass(frozen=True)
class StoredResults:
    """Results under `path`: `key` and the columns of `schema`, in `parts` parts (fixed for good)."""

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: int = 64

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """run, computed (contents) of the runs that ended."""
        return self._table("runs", T.StructType.fromDDL("run string, computed bigint"))

    def as_of(self) -> DataFrame:
        """key and results of the runs that have ended by now; later runs do not show in it."""
        names = [r["run"] for r in self.runs().select("run").toLocalIterator()]
        return self._rows().where(F.col("run").isin(names)).drop("run", "part").dropDuplicates(["key"])

    def _rows(self) -> DataFrame:
        fields = [T.StructField("key", T.StringType()), *self.schema.fields, *T.StructType.fromDDL("run string, part int").fields]
        return self._table("data", T.StructType(fields))

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """key and results; with `parts`, only of those parts. A key met by two runs at once is given once."""
        rows = self._rows()
        if parts is not None:
            rows = rows.where(F.col("part").isin(parts))
        rows = rows.join(self.runs().select("run"), "run", "left_semi")
        return rows.drop("run", "part").dropDuplicates(["key"])

    def run(self, inputs: DataFrame, content: str, salt: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """(`inputs` with `key` and their results, number of contents computed).

        `compute` takes the inputs of new contents, one row each with its `key`, to rows of `key` and results. A null content
        has no key and no result.
        """
        keyed = inputs.withColumn("key", content_key(content, salt))
        some = keyed.where(F.col("key").isNotNull())
        parts = sorted(r["part"] for r in some.select(self._part().alias("part")).distinct().collect())
        known = self.read(parts).select("key")
        fresh = compute(some.dropDuplicates(["key"]).join(known, "key", "left_anti")).select("key", *self.schema.names)
        run, count = uuid.uuid4().hex, Observation()
        fresh = fresh.withColumn("part", self._part()).observe(count, F.count(F.lit(1)).alias("n"))
        fresh.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.path}/data/run={run}")
        n = count.get["n"]
        self.spark.createDataFrame([(run, n)], "run string, computed bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return keyed.join(self.read(parts), "key", "left"), n
