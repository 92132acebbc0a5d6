"""A small graph of datasets: declare them with their inputs, run them in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality

KINDS = ("view", "materialized_view", "streaming_table", "feature_table")


@dataclass(frozen=True)
class Dataset:
    name: str
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    kind: str = "materialized_view"
    keys: tuple[str, ...] = ()
    time_key: str | None = None
    private: bool = False
    rules: dict = field(default_factory=dict)
    action: str = "warn"


class Graph:
    """Views stay lazy; tables are written once per run and read back, so a parent that
    several children filter is computed once."""

    def __init__(self) -> None:
        self.datasets: dict[str, Dataset] = {}

    def dataset(self, name: str | None = None, *, inputs: Sequence[str] = (), **options):
        def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            d = Dataset(name or build.__name__, build, tuple(inputs), **options)
            if d.kind not in KINDS:
                raise ValueError(f"unknown kind {d.kind}")
            if d.name in self.datasets:
                raise ValueError(f"dataset {d.name} is declared twice")
            self.datasets[d.name] = d
            return build

        return add

    def order(self) -> list[str]:
        known = {n: [i for i in d.inputs if i in self.datasets] for n, d in self.datasets.items()}
        return [n for n in TopologicalSorter(known).static_order() if n in self.datasets]

    def run(self, spark: SparkSession, sources: dict[str, DataFrame], root: str, update: str = "update-1") -> tuple[dict[str, DataFrame], DataFrame]:
        """All public datasets, and the expectation events of the run."""
        made, events = dict(sources), []
        for name in self.order():
            d = self.datasets[name]
            out = d.build(*[made[i] for i in d.inputs])
            watch = None
            if d.rules:
                out, watch = quality.expect(out, d.rules, d.action, f"{update}-{name}")
            if d.kind != "view":
                path = f"{root}/{name}"
                out.write.mode("overwrite").parquet(path)
                out = spark.read.schema(out.schema).parquet(path)
                if d.keys:
                    self._unique(out, d)
                if watch is not None:
                    seen = watch.get
                    events += [(update, name, rule, seen["rows"] - seen[rule], seen[rule]) for rule in d.rules]
            else:
                out.createOrReplaceTempView(name)
            made[name] = out
        log = spark.createDataFrame(events, "update_id string, dataset string, rule string, passed_records long, failed_records long")
        return {n: made[n] for n, d in self.datasets.items() if not d.private}, log

    @staticmethod
    def _unique(df: DataFrame, d: Dataset) -> None:
        keys = [*d.keys, *([d.time_key] if d.time_key else [])]
        if df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count():
            raise ValueError(f"{d.name}: keys {keys} are not unique")
