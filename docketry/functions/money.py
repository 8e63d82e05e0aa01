"""Amounts. Money is DECIMAL; text that is no amount becomes NULL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
_WIDE = "decimal(18,2)"
_STEP = Decimal("1.05")


def clean_amount(text: Column) -> Column:
    """``$1,234.50`` and the like; ``350,00.00`` is read as 350,000.00."""
    bare = F.trim(F.regexp_replace(text, r"[\$\s]", ""))
    bare = F.regexp_replace(bare, r"^(\d{1,3}),(\d{2})(\.\d{2})$", "$1,$2" + "0$3")
    return F.replace(bare, F.lit(","), F.lit("")).try_cast(_WIDE)


def plain_amount(text: Column) -> Column:
    """Commas dropped, nothing else repaired."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast(_WIDE)


def strict_amount(text: Column, needs_dot: bool = True) -> Column:
    """Digits and dots only, between 100 and 100,000,000; the bid-notice form also wants a dot."""
    bare = F.regexp_replace(text, r"[^0-9.]", "")
    value = bare.try_cast(_WIDE)
    ok = value.between(F.lit(100), F.lit(100_000_000))
    if needs_dot:
        ok = ok & F.contains(bare, F.lit("."))
    return F.when(ok, value)


def loose_amount(text: Column) -> Column:
    return strict_amount(text, needs_dot=False)


def min_next_bid(bid: Column) -> Column:
    """Five per cent above the bid, half-even to the cent."""
    return F.bround(bid * F.lit(_STEP), 2).cast(MONEY)


def bid_from_min(minimum: Column) -> Column:
    """The bid a stated minimum next bid was computed from."""
    return F.bround(minimum / F.lit(_STEP), 2).cast(MONEY)


def present(amount: Column) -> Column:
    """Zero counts as missing."""
    return F.when(amount != 0, amount)


def est_profit(sale_price: Column, max_bid: Column, rehab: Column) -> Column:
    """Sale price less maximum bid and rehabilitation cost; NULL while price or bid is missing."""
    return F.when(
        present(sale_price).isNotNull() & present(max_bid).isNotNull(),
        sale_price - max_bid - F.coalesce(rehab, F.lit(0).cast(MONEY)),
    ).cast("decimal(14,2)")
