"""K3: the registry of loaded datasets, backed by temp views."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkeda.dataset import Dataset


def make_key(name: str, taken) -> str:
    """Lower-case, spaces to ``_``; on collision append ``_2``, ``_3``, ..."""
    key = name.lower().replace(" ", "_")
    views = {view_name(t) for t in taken}  # two keys must not share a view either
    if view_name(key) in views:
        i = 2
        while view_name(f"{key}_{i}") in views:
            i += 1
        key = f"{key}_{i}"
    return key


def view_name(key: str) -> str:
    """The key as a name that SQL takes: ``ventas-2024.csv`` -> ``ventas_2024_csv``; a leading digit gets ``_``."""
    name = re.sub(r"\W", "_", key)
    return f"_{name}" if name[:1].isdigit() else name


class Registry:
    """Named datasets; each is also a temp view so SQL (Q1) can reach it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._items: dict[str, Dataset] = {}

    def register(self, item, name: str | None = None) -> str:
        if isinstance(item, DataFrame):
            item = Dataset(name=name or "dataset", df=item, origin="dataframe")
        key = make_key(name or item.name, self._items)
        self._items[key] = item
        item.df.createOrReplaceTempView(view_name(key))
        return key

    def get(self, key: str) -> Dataset:
        if key not in self._items:
            raise KeyError(f"no dataset '{key}'; registered: {sorted(self._items)}")
        return self._items[key]

    def keys(self) -> list[str]:
        return list(self._items)

    def drop(self, key: str) -> None:
        self._items.pop(key)
        self.spark.catalog.dropTempView(view_name(key))

    def list(self, with_counts: bool = True) -> DataFrame:
        """key, rows, columns, origin for each registered dataset."""
        counts = [ds.df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, ds in self._items.items()] if with_counts else []
        counts = {r["k"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()} if counts else {}  # one job
        rows = [(k, counts.get(k), len(ds.df.columns), ds.origin) for k, ds in self._items.items()]
        return self.spark.createDataFrame(rows, "key string, rows long, columns int, origin string")

    def __contains__(self, key):
        return key in self._items

    def __len__(self):
        return len(self._items)
