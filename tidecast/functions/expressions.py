"""Column expressions of the forecast engine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the forecast method.
HORIZONS = (30, 60, 90)
N_SIMS, SEED, BLOCK = 2000, 42, 7
HOLIDAY_FROM, HOLIDAY_TO = 1120, 1231  # month and day
HILL_GAMMA = 0.5
RUN_RATE_DAYS, TREND_DAYS, CLIP_PERCENTILE = 28, 120, 0.97
GROWTH, COLD_RESIDUAL = 1.05, 0.05
MIN_CAMPAIGN_DAYS, MIN_SHRINKAGE_DAYS = 30, 3
ELASTICITY_MIN_PAIRS, ELASTICITY_MOST, ELASTICITY_BOOTSTRAPS, ELASTICITY_CI_WIDTH = 10, 2.0, 500, 1.0
SCALES, SCALE_COVERAGE = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), 66.7
CUTOFFS, MORE_CUTOFFS, MIN_SPLIT_CUTOFFS, MIN_TRAIN_DAYS, TEST_DAYS = 3, 6, 4, 45, 30
CHANNEL_INFLATION = {"bing": 1.0, "google": 1.0, "meta": 1.3}
SHIFT, MOST_RECEIVER, MIN_DONOR_SPEND, POOL, TOP, SEARCH_SIMS = 0.20, 2.5, 5.0, 3, 5, 500
RETRO_OFFSETS, RETRO_MIN_TRAIN = (180, 150, 120, 90, 60), 90
GAP_DAYS, OVERSPEND = 14, 1.05


def funnel_stage(name: Column) -> Column:
    """high_intent for re-marketing and trademark names, else prospecting."""
    low = F.lower(F.coalesce(name, F.lit("nan")))
    hit = low.contains("remarketing") | low.contains("retarget") | low.contains("_tm_")
    return F.when(hit, "high_intent").otherwise("prospecting")


def type_of_name(name: Column) -> Column:
    return F.regexp_replace(name, r"_Campaign_\d+$", "")


def is_holiday(date: Column) -> Column:
    return (F.month(date) * 100 + F.day(date)).between(HOLIDAY_FROM, HOLIDAY_TO)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rounded(x: Column, digits: int) -> Column:
    """round(), with the sign of what rounds to zero: a small loss is -0.0, as in SQL."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def response(multiple: Column, beta: Column, gamma: float = HILL_GAMMA) -> Column:
    """How revenue follows a multiple of spend: a power below 1, saturating above."""
    power = F.pow(multiple, beta)
    extra = power - 1
    return F.when(multiple <= 0, F.lit(0.0)).when(multiple == 1, F.lit(1.0)).when(multiple < 1, power).otherwise(1 + extra / (1 + gamma * extra))


def pinball(actual: Column, quantile: Column, tau: float) -> Column:
    return F.greatest(tau * (actual - quantile), (tau - 1) * (actual - quantile))


# Fixed values of the draws: a step and a factor that mix 32 bits well.
STEP, MIX, BITS = 2654435769, 73244475, 4294967295


def streams(key: str, numbers: Iterable[int], *purpose: str | int) -> np.ndarray:
    """32-bit numbers from key, number and purpose alone, with which streams of draws begin."""
    end = "".join(f"|{p}" for p in purpose)
    return np.array([int.from_bytes(hashlib.md5(f"{key}|{n}{end}".encode()).digest()[:4], "big") for n in numbers], np.int64)


def key_text(*keys: str) -> Column:
    """A key's columns as one text, as draws are keyed by it."""
    return F.concat_ws("|", *keys)


def drawn(begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Draws of 32 bits: number `at` of the streams that begin so. The same in any order,
    on any number of partitions and, being plain arithmetic, in other engines."""
    x = (begin + at * STEP) & BITS
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) & BITS
    return x ^ (x >> 16)
