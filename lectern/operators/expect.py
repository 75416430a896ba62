"""Tables that are written only if they are as expected: the checks are taken in the write's own pass.

An expectation is a condition every row meets; a null is a breach. `observe` counts the breaches and keeps the least row that
shows one while the rows are written aside, so nothing is scanned twice. Only a table without breaches is moved to its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import move_folder, remove_folder


class BuildError(Exception):
    """Some expectation does not hold."""


class Watch:
    """Expectations and totals of one pass over a table.

    expected: name -> condition of a row. totals: name -> aggregate of the whole table, reported with the counts of breaches.
    within: name of a total -> (least, greatest) it may be, None for no bound. examples: columns that tell a row.
    """

    def __init__(
        self,
        expected: Mapping[str, Column],
        totals: Mapping[str, Column] | None = None,
        within: Mapping[str, tuple[int | None, int | None]] | None = None,
        examples: tuple[str, ...] = ("doc_id",),
    ) -> None:
        self.expected, self.totals, self.within, self.examples = dict(expected), dict(totals or {}), dict(within or {}), examples
        unknown = set(self.within) - set(self.totals)
        if unknown:
            raise ValueError(f"bounds of unknown totals: {sorted(unknown)}")
        self._seen = Observation()

    def on(self, rows: DataFrame) -> DataFrame:
        """`rows` watched: to be put right before the write, where each row passes once."""
        breach = {n: ~F.coalesce(c, F.lit(False)) for n, c in self.expected.items()}
        found = [F.count_if(b).alias(f"n:{n}") for n, b in breach.items()]
        found += [F.min(F.when(b, F.struct(*self.examples))).cast("string").alias(f"e:{n}") for n, b in breach.items()]
        return rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), *found, *[c.alias(f"t:{n}") for n, c in self.totals.items()])

    def report(self) -> dict[str, int]:
        """Rows, breaches by expectation and totals, once the write is done."""
        seen = self._seen.get
        return {"rows": seen["rows"], **{n: seen[f"n:{n}"] for n in self.expected}, **{n: seen[f"t:{n}"] for n in self.totals}}

    def enforce(self) -> dict[str, int]:
        """The report; `BuildError` if an expectation or a bound is broken."""
        seen, report = self._seen.get, self.report()
        broken = [f"{n}: {report[n]} rows, such as {seen[f'e:{n}']}" for n in self.expected if report[n]]
        for n, (low, high) in self.within.items():
            if report[n] is None or (low is not None and report[n] < low) or (high is not None and report[n] > high):
                broken.append(f"{n}: {report[n]} is not within {low} and {high}")
        if broken:
            raise BuildError("; ".join(broken))
        return report


def write_expected(rows: DataFrame, path: str, watch: Watch) -> dict[str, int]:
    """Write `rows` to the new folder `path` and give the report; on a breach `path` does not come to be."""
    spark, aside = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    try:
        watch.on(rows).write.parquet(aside)
        report = watch.enforce()
        move_folder(spark, aside, path)
    finally:
        remove_folder(spark, aside)
    return report
