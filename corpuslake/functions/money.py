"""Money, currency and price scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .exprs import let

MONEY = "decimal(18,2)"
_WIDE = "decimal(28,8)"


def money(value: Column) -> Column:
    """Two decimals, half up."""
    return F.round(value.cast(_WIDE), 2).cast(MONEY)


def half_even(value: Column, digits: int) -> Column:
    """Half-even rounding of floats."""
    return F.bround(value, digits)


def normalize_currency(value: Column) -> Column:
    """Symbol or word forms to PHP or USD; null and unknown are USD."""
    upper = F.upper(F.trim(value))
    peso = value.contains("₱") | upper.isin("PHP", "PESO", "PESOS", "PH PESO", "PH PESOS")
    return F.when(peso, F.lit("PHP")).otherwise(F.lit("USD"))


def convert_currency(amount: Column, source: Column, target: Column,
                     rate: Column | float = fv.PESOS_PER_DOLLAR) -> Column:
    """Convert pesos and dollars at pesos-per-dollar ``rate``; unusable amounts are 0.00."""
    rate = rate if isinstance(rate, Column) else F.lit(str(rate))
    rate = rate.cast("decimal(18,6)")
    rate = F.when(rate > 0, rate).otherwise(F.lit(str(fv.PESOS_PER_DOLLAR)).cast("decimal(18,6)"))
    value = amount.try_cast("decimal(20,6)")
    src, dst = normalize_currency(source), normalize_currency(target)
    converted = (F.when(src == dst, value.cast("decimal(38,12)"))
                 .when(src == "PHP", (value / rate).cast("decimal(38,12)"))
                 .otherwise((value * rate).cast("decimal(38,12)")))
    return F.coalesce(F.round(converted, 2).cast(MONEY), F.lit("0.00").cast(MONEY))


def estimate_cost(prompt: Column, completion: Column,
                  prompt_rate: Column | float = fv.PRICE_PER_1K_PROMPT,
                  completion_rate: Column | float = fv.PRICE_PER_1K_COMPLETION) -> Column:
    """Token price; null only when both counts are null.  Rates may be columns of a price table."""
    def usable(rate, default):
        rate = rate if isinstance(rate, Column) else F.lit(rate)
        return F.coalesce(rate.try_cast("double"), F.lit(default))

    total = (F.coalesce(prompt, F.lit(0)) / F.lit(1000.0) * usable(prompt_rate, fv.PRICE_PER_1K_PROMPT)
             + F.coalesce(completion, F.lit(0)) / F.lit(1000.0) * usable(completion_rate, fv.PRICE_PER_1K_COMPLETION))
    return F.when(prompt.isNotNull() | completion.isNotNull(), total)


def format_money(value: Column, symbol: str = "") -> Column:
    """Thousands-separated amount; an em dash where there is none."""
    number = value.try_cast("decimal(28,6)")
    return F.coalesce(F.concat(F.lit(symbol), F.format_number(number, 2)), F.lit("—"))


def format_day(value: Column, pattern: str = "d MMMM yyyy") -> Column:
    return F.coalesce(F.date_format(value, pattern), F.lit(""))


def slug_words(value: Column, fallback: str = "") -> Column:
    """Lower-case words joined by underscores."""
    slug = F.btrim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def quote_number(proposal_id: Column, day: Column, prefix: str = "Q") -> Column:
    return F.concat_ws("-", F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.upper(F.substring(proposal_id, 1, 6)))


def float_round(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals by its exact binary value, ties to even.

    ``bround`` rounds the shortest decimal text of a double, which turns 1.05 into a tie it
    is not.  The product with the power of ten is therefore split into its rounded part and
    the exact remainder, and the remainder decides apparent ties.
    """
    s = F.lit(float(10 ** digits))

    def split(x: Column) -> Column:
        c = x * F.lit(134217729.0)
        return F.struct(x.alias("x"), (x * s).alias("p"), (c - (c - x)).alias("high"))

    def decide(v: Column) -> Column:
        low = F.floor(v["p"]).cast("double")
        half = v["p"] - low
        rest = (v["high"] * s - v["p"]) + (v["x"] - v["high"]) * s
        up = (half > 0.5) | ((half == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))))
        return (low + F.when(up, 1.0).otherwise(0.0)) / s

    return let(let(value.cast("double"), split), decide)
