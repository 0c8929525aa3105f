"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, LongType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass
class Plan(AnalyzeResult):
    """What analyze found, handed to the workers."""

    key: str = ""
    numeric: list[str] = field(default_factory=list)


class ColumnStatistics:
    """column_statistics(TABLE(t) PARTITION BY k, key => 'k'): the other columns' statistics for each partition, whatever the columns are.

    Every plain column of the table that is numeric or boolean, but for the key, gives <name>_n, <name>_mean, <name>_std
    (population), <name>_least and <name>_most, over values that are neither null nor NaN (no value: n = 0, the rest null).
    ``key => 'k'`` names the column that comes along. Sums run along by Welford's rule, so a partition of any size
    takes a few numbers. A partition is one task; where one key may hold most rows, a grouped aggregate is the way.
    """

    @staticmethod
    def analyze(t: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        if not t.isTable or not isinstance(t.dataType, StructType) or not key.isConstantExpression or key.value not in t.dataType.names:
            raise ValueError("column_statistics takes a table and the name of one of its columns")
        schema = StructType([t.dataType[key.value]])
        numeric = [f.name for f in t.dataType.fields if f.name != key.value and isinstance(f.dataType, NumericType | BooleanType)]
        for name in numeric:
            schema = schema.add(f"{name}_n", LongType())
            for s in ("mean", "std", "least", "most"):
                schema = schema.add(f"{name}_{s}", DoubleType())
        return Plan(schema, key=key.value, numeric=numeric)

    def __init__(self, plan: Plan):
        self.plan, self.key, self.seen = plan, None, None

    def eval(self, row: Row, key: str) -> None:
        if self.seen is None:
            self.key, self.seen = row[self.plan.key], {name: [0, 0.0, 0.0, None, None] for name in self.plan.numeric}
        for name, s in self.seen.items():
            v = row[name]
            if v is None or v != v:
                continue
            x = float(v)
            s[0] += 1
            d = x - s[1]
            s[1] += d / s[0]
            s[2] += d * (x - s[1])
            s[3], s[4] = x if s[3] is None else min(s[3], x), x if s[4] is None else max(s[4], x)

    def terminate(self) -> Iterator[tuple]:
        if self.seen is not None:
            out = [self.key]
            for n, mean, m2, least, most in self.seen.values():
                out += [n, mean if n else None, (m2 / n) ** 0.5 if n else None, least, most]
            yield tuple(out)


def register(spark: SparkSession) -> None:
    """Makes column_statistics known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("column_statistics", udtf(ColumnStatistics))
