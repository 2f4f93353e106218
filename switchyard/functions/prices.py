"""Token prices: a checked calculation for single values and the same as a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from switchyard.errors import CanonicalDataError

#: Tokens that a price is quoted for.
UNIT_TOKENS = 1_000_000


@dataclass(frozen=True)
class PriceRates:
    """Prices of a unit of tokens; without a cached price, cached input cannot be billed."""

    input_per_unit: float
    cached_input_per_unit: float | None
    output_per_unit: float

    def validate(self) -> None:
        for name, value in vars(self).items():
            if value is not None and value < 0:
                raise CanonicalDataError(f"{name} must be non-negative")


def compute_cost_usd(*, input_tokens: int, output_tokens: int, rates: PriceRates, cached_input_tokens: int = 0) -> float:
    """Cost of one call.  Counts must be whole and not negative, cached ones part of the input and priced."""
    rates.validate()
    counts = {"input_tokens": input_tokens, "output_tokens": output_tokens, "cached_input_tokens": cached_input_tokens}
    for name, value in counts.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise CanonicalDataError(f"{name} must be a non-negative integer")
    if cached_input_tokens > input_tokens:
        raise CanonicalDataError("cached_input_tokens cannot exceed input_tokens")
    if cached_input_tokens and rates.cached_input_per_unit is None:
        raise CanonicalDataError("cached tokens need a cached-input price")
    fresh = (input_tokens - cached_input_tokens) * rates.input_per_unit
    cached = cached_input_tokens * (rates.cached_input_per_unit or 0.0)
    return (fresh + cached + output_tokens * rates.output_per_unit) / UNIT_TOKENS


def cost_usd(input_tokens: Column, cached_tokens: Column, output_tokens: Column, input_price: Column, cached_price: Column, output_price: Column) -> Column:
    """The same calculation as a column; a row that breaks a rule fails the query."""
    bad = (
        F.when((input_tokens < 0) | (cached_tokens < 0) | (output_tokens < 0), F.lit("token counts must be a non-negative integer"))
        .when((input_price < 0) | (cached_price < 0) | (output_price < 0), F.lit("prices must be non-negative"))
        .when(cached_tokens > input_tokens, F.lit("cached_input_tokens cannot exceed input_tokens"))
        .when((cached_tokens > 0) & cached_price.isNull(), F.lit("cached tokens need a cached-input price"))
    )
    total = ((input_tokens - cached_tokens) * input_price + cached_tokens * F.coalesce(cached_price, F.lit(0.0)) + output_tokens * output_price) / F.lit(UNIT_TOKENS)
    return F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(total)
