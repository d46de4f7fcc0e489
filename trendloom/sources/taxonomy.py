"""Taxonomy files as three small dimension tables, and token lists."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.operators.models import TrainConfig
from trendloom.functions.text import strip
from trendloom.sources.tickets import exists_or_none

LABEL_KEY = "label_ru"


def _label(code: str, body) -> str:
    """Label of a code: its label entry, a bare value, or the code itself."""
    if isinstance(body, Mapping):
        return str(body.get(LABEL_KEY, code))
    return code if body is None else str(body)


@dataclass(frozen=True)
class Taxonomy:
    """Codes and labels of categories, subcategories and loan products."""

    categories: list[tuple[str, str]] = field(default_factory=list)
    subcategories: list[tuple[str, str, str]] = field(default_factory=list)
    loan_products: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: Mapping | None) -> Taxonomy:
        """From nested data; a category body may be a mapping, a list or a scalar."""
        raw = raw or {}
        categories, subcategories = [], []
        for code, body in (raw.get("categories") or {}).items():
            nested = body.get("subcategories") if isinstance(body, Mapping) else None
            categories.append((code, _label(code, body) if isinstance(body, Mapping) else code))
            if isinstance(nested, Mapping):
                subcategories += [(code, sub, _label(sub, meta)) for sub, meta in nested.items()]
            elif isinstance(nested, list):
                subcategories += [(code, str(sub), str(sub)) for sub in nested]
        loans = [
            (code, _label(code, body) if isinstance(body, (Mapping, str)) else code)
            for code, body in (raw.get("loan_products") or {}).items()
        ]
        return cls(categories, subcategories, loans)

    @classmethod
    def default(cls) -> Taxonomy:
        return cls.parse(fv.TAXONOMY)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Taxonomy:
        """From a JSON or YAML file on any file system Spark can read."""
        text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.parse(yaml.safe_load(text))
        return cls.parse(json.loads(text))

    def category_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.categories, "code string, label string")

    def subcategory_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.subcategories, "category string, code string, label string")

    def loan_product_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.loan_products, "code string, label string")


def normal_tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, lower-cased, non-empty, distinct tokens of a one-per-line list."""
    token = F.lower(strip(F.col(column)))
    return lines.select(token.alias("token")).filter(F.col("token") != "").distinct()


def load_tokens(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Token list of one file; a file that does not exist gives an empty list."""
    lines = exists_or_none(lambda: spark.read.text(f"{folder.rstrip('/')}/{name}"))
    return normal_tokens(spark.createDataFrame([], "value string") if lines is None else lines)


def token_union(*lists: DataFrame) -> DataFrame:
    """Distinct tokens of several lists."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()


def deny_tokens(spark: SparkSession, cfg: TrainConfig) -> tuple[str, ...]:
    """Tokens that cleaning removes: those of the configured files, or the configured tuple.

    A token list becomes one pattern in an expression, so it is held on the driver.
    """
    if cfg.token_dir is None:
        return cfg.deny_tokens
    lists = [load_tokens(spark, cfg.token_dir, name) for name in cfg.token_files]
    return tuple(sorted(r["token"] for r in token_union(*lists).collect()))
