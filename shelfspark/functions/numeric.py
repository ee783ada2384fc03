"""Panel scalars (Column -> Column). All built-in expressions, so they stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the panel logic.
HEALTH_DEFAULTS = {"sentiment": 0.7, "demand": 50.0, "search": 50.0}
HEALTH_WEIGHTS = (0.4, 0.3, 0.3)          # sentiment*100, demand, search
MOMENTUM = {"positive": 1.02, "negative": 0.98}   # anything else: 1.0
RETRAIN_EVERY_N_DAYS = 7
DRIFT_RETRAIN_THRESHOLD = 8.0
DRIFT_FLAG_THRESHOLD = 5.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """Round half up on the binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Written as plain IEEE arithmetic so that any engine (and the DuckDB oracle, which uses the
    same formula) gives the identical double; Spark's ``round`` rounds the shortest decimal
    string instead, which differs from other engines on near-ties."""
    m = float(10 ** digits)
    return F.floor(col(c) * m + 0.5) / m


def c_health(sentiment="sentiment_index", demand="demand_index", search="search_index") -> Column:
    """sentiment*100*0.4 + demand*0.3 + search*0.3, rounded to 2; defaults for missing."""
    s = F.coalesce(col(sentiment), F.lit(HEALTH_DEFAULTS["sentiment"]))
    d = F.coalesce(col(demand), F.lit(HEALTH_DEFAULTS["demand"]))
    q = F.coalesce(col(search), F.lit(HEALTH_DEFAULTS["search"]))
    ws, wd, wq = HEALTH_WEIGHTS
    return round_half_up(s * 100 * ws + d * wd + q * wq, 2)


def c_momentum(direction="impact_direction") -> Column:
    d = col(direction)
    return F.when(d == "positive", F.lit(MOMENTUM["positive"])) \
        .when(d == "negative", F.lit(MOMENTUM["negative"])).otherwise(F.lit(1.0))


def c_hash_noise(amplitude: float, *keys) -> Column:
    """Deterministic stand-in for the reference's unseeded uniform noise: a value in
    [-amplitude, amplitude) from ``xxhash64`` of the keys. Amplitude 0 gives exactly 0."""
    if not amplitude:
        return F.lit(0.0)
    u = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(1_000_000)).cast("double") / 1_000_000.0
    return (u * 2 - 1) * amplitude


def c_should_retrain(day="sim_day", drift="drift_score", every: int = RETRAIN_EVERY_N_DAYS,
                     threshold: float = DRIFT_RETRAIN_THRESHOLD) -> Column:
    """Periodic (day > 0 and day % every == 0) or drift above threshold."""
    d = col(day)
    return ((d > 0) & (d % every == 0)) | (F.coalesce(col(drift), F.lit(0.0)) > threshold)


def c_next_version(v="model_version") -> Column:
    """``v1.0`` -> ``v1.1``."""
    num = F.expr("try_cast(substring({0}, 2) AS DOUBLE)".format(v)) if isinstance(v, str) else \
        F.substring(col(v), 2, 1 << 20).try_cast("double")
    return F.format_string("v%.1f", F.coalesce(num, F.lit(1.0)) + 0.1)


def c_version_after(n_retrains, base: float = 1.0) -> Column:
    """Version string after ``n`` bumps of 0.1 starting from ``v{base}``."""
    return F.format_string("v%.1f", F.lit(base) + col(n_retrains) * 0.1)


def c_naive_demand(search="search_index", ad="ad_index", sentiment="sentiment_index", bias=0.0) -> Column:
    """Model-less demand estimate; when an input is missing the reference's error branch
    (0.5*search + 25) applies; bias added; rounded to 4."""
    s, a, m = col(search), col(ad), col(sentiment)
    main = s * 0.4 + a * 0.3 + m * 100 * 0.2 + 30 * 0.1
    fallback = F.coalesce(s, F.lit(0.0)) * 0.5 + 25.0
    b = col(bias) if not isinstance(bias, (int, float)) else F.lit(float(bias))
    return round_half_up(F.coalesce(main, fallback) + b, 4)


def c_first_int(c) -> Column:
    """First run of digits as an integer, NULL when none."""
    return F.nullif(F.regexp_extract(col(c), r"(\d+)", 1), F.lit("")).try_cast("bigint")
