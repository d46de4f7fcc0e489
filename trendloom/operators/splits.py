"""Training / validation splits of exact size, without a global sort."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.operators.ordering import first_rows


@dataclass(frozen=True)
class SplitConfig:
    """By time (an inclusive window, or the latest share) or by a seeded hash of the id."""

    mode: str = "time"
    test_share: float = fv.TEST_SHARE
    val_from: str | None = None
    val_to: str | None = None
    seed: int = fv.SEED


def _hash_levels(row_id: Column) -> list[Column]:
    # the digits of the hash as numbers of the same order, then the id for rows whose hashes tie
    digest = F.md5(row_id)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)] + [row_id]


def _time_levels(event_time: Column, row_id: Column) -> list[Column]:
    """Microseconds, then a hash of the id, so that any number of tickets at one instant has an order."""
    return [F.unix_micros(event_time.cast("timestamp")), *_hash_levels(row_id)]


def earliest_share(df: DataFrame, share: float, row_id: str = "row_id", event_time: str = "event_time") -> Column:
    """Predicate for the earliest ``int(share * rows)`` rows; ties go by the hash of the id."""
    cut = int(df.count() * share)
    return first_rows(df, _time_levels(F.col(event_time), F.col(row_id)), cut)


def random_share(df: DataFrame, share: float, seed: int, row_id: str = "row_id") -> Column:
    """Predicate for exactly ``ceil(share * rows)`` rows, picked by a seeded hash of the id."""
    size = math.ceil(df.count() * share)
    return first_rows(df, _hash_levels(F.concat(F.lit(f"{seed}:"), F.col(row_id))), size)


def with_split(df: DataFrame, cfg: SplitConfig, row_id: str = "row_id", event_time: str = "event_time") -> DataFrame:
    """Add ``is_validation``.

    A time split uses the configured inclusive window unless one side would be
    empty; otherwise the latest fifth validates.  Without event times, or in
    random mode, a hashed fifth does.
    """
    if cfg.mode != "time" or event_time not in df.columns:
        return df.withColumn("is_validation", random_share(df, cfg.test_share, cfg.seed, row_id))
    if cfg.val_from or cfg.val_to:
        at = F.col(event_time)
        inside = F.lit(True)
        if cfg.val_from:
            inside = inside & (at >= F.lit(cfg.val_from).cast("timestamp_ntz"))
        if cfg.val_to:
            inside = inside & (at <= F.lit(cfg.val_to).cast("timestamp_ntz"))
        inside = F.coalesce(inside, F.lit(False))
        sizes = df.agg(F.count_if(inside).alias("v"), F.count_if(~inside).alias("t")).first()
        if sizes["v"] and sizes["t"]:
            return df.withColumn("is_validation", inside)
    early = earliest_share(df, 1 - cfg.test_share, row_id, event_time)
    return df.withColumn("is_validation", ~early)


def training_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_validation"))


def validation_rows(df: DataFrame) -> DataFrame:
    return df.filter("is_validation")
