"""Column functions of the demand domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The lowest whole quantity of each demand level, and the level's code.
LEVELS = {0: 0, 1: 1, 2: 2, 5: 3, 20: 4}

# What the ledger says for each channel.
ONLINE = ("oln", "online", "on", "线上", "網上", "网上")
OFFLINE = ("ofln", "offline", "off", "线下", "門店", "门店")
BUCKETS = ("0", "1", "2-5", "5-20", "20+")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def finite(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    c = c.cast("double")
    return F.when(F.abs(c) < float("inf"), c).otherwise(0.0)  # NaN is above infinity; few uses of c, as each is computed by itself


def numeric(c: Column) -> Column:
    """Text or number to a double; what is no number becomes 0."""
    return finite(c.try_cast("double"))


def clip_target(c: Column) -> Column:
    return F.greatest(finite(c), F.lit(0.0))


def demand_bucket(c: Column) -> Column:
    """Buckets of the metrics: 0, below 2, below 5, below 20, more."""
    x = clip_target(c)
    return F.when(x == 0, "0").when(x < 2, "1").when(x < 5, "2-5").when(x < 20, "5-20").otherwise("20+")


def longtail_bucket(c: Column) -> Column:
    """Buckets of the long-tail report: at most 0, exactly 1, at most 5, at most 20, more."""
    return F.when(c <= 0, "0").when(c == 1, "1").when(c <= 5, "2-5").when(c <= 20, "5-20").otherwise("20+")


def half_up(c: Column, months: int = 1) -> Column:
    """Whole monthly quantity: half goes up, negatives to 0."""
    return F.floor(F.greatest(finite(c) / months, F.lit(0.0)) + 0.5).cast("long")


def level(c: Column, months: int = 1, levels: dict[int, int] = LEVELS) -> Column:
    """Demand level of a quantity over that many months: the code of the highest bound that it reaches."""
    top = max(levels)
    codes = [levels[max([b for b in levels if b <= i], default=min(levels))] for i in range(top + 1)]
    return F.get(F.array(*map(F.lit, codes)), F.least(half_up(c, months), F.lit(top)).cast("int"))  # one use of c, as each is computed by itself


def direction(current: Column, future: Column, tolerance: float = 0.0) -> Column:
    delta = future.cast("double") - current.cast("double")
    return F.when(delta > tolerance, 1).when(delta < -tolerance, -1).otherwise(0)


def channel(c: Column) -> Column:
    value = F.lower(F.trim(c))
    return F.when(value.isin(*ONLINE), "online").when(value.isin(*OFFLINE), "offline").otherwise("unknown")


def month_index(c: Column) -> Column:
    """Months since year 0 of a date."""
    return F.year(c) * 12 + F.month(c) - 1


def month_text(index: Column) -> Column:
    year, month = F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int")
    padded = lambda c, n: F.when(c >= 10 ** (n - 1), c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))  # noqa: E731  format_string takes several times as long
    return F.concat(padded(year, 4), F.lit("-"), padded(month, 2))


def month_of(text: Column) -> Column:
    """Index of 'yyyy-MM'."""
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int") - 1


def history_pattern(lag1: Column, lag2: Column, lag3: Column) -> Column:
    mean, spread = (lag1 + lag2 + lag3) / 3, F.greatest(lag1, lag2, lag3) - F.least(lag1, lag2, lag3)
    return F.when(F.least(lag1, lag2, lag3) >= 5, "persistent_high").when(mean <= 1, "sudden_burst_from_low").when(spread >= 5, "volatile").otherwise("other")


def stable_error(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual) / F.greatest(F.abs(actual), F.lit(1.0))


def difficulty(actual: Column, predicted: Column) -> Column:
    error, stable = F.abs(predicted - actual), stable_error(actual, predicted)
    return F.when((error >= 10) | (stable >= 1), "hard").when((error >= 5) | (stable >= 0.5), "medium").otherwise("easy")


def hash_uniform(*parts: Column | str) -> Column:
    """A number of [0, 1) that the parts alone decide."""
    digest = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
