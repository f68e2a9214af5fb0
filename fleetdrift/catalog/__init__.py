"""Registered queries: each operator bound to the driver tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derive import VIEWS, with_views

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOMES: dict[str, str] = {}


class Tables:
    """The driver tables of one scale factor, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str, *views: str) -> DataFrame:
        """Run portable SQL; ``views`` are put in front as common table expressions."""
        query = with_views(text, views)
        for name in TABLES:
            if name in query:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def view(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.sql(f"SELECT * FROM {name}", name)
        return self._known[name]


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` is its SQL twin over ``views``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        HOMES[name] = fn.__module__.rsplit(".", 1)[-1]
        if oracle is not None:
            ORACLES[name] = with_views(oracle, views)
        return fn

    return register


def load_all() -> None:
    """Import every binding module once, so that the registries are full."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"{__name__}.{module}")


MODULES: tuple[str, ...] = ("snapshots", "versions", "vulnerabilities", "scans", "contracts", "repairs", "readers", "lifecycles", "streams", "composites")

__all__ = ["HOMES", "MODULES", "ORACLES", "QUERIES", "TABLES", "Tables", "VIEWS", "load_all", "query"]
