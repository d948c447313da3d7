"""Factors of company accounts joined to the panel as of their publication: the panel brings columns roe, accruals and bvps."""

from __future__ import annotations

from ..functions import expr as X
from ..functions.expr import Expr, col

#: A date with fewer known values has no cross-section to rank in.
LEAST_RANKED = 3


def fundamentals() -> dict[str, Expr]:
    """Unknown changes count as none and unknown ranks as the middle; unknown accruals, returns and book values stay missing."""
    roe = col("roe")
    before = X.delay(roe, 1)
    change = X.minimum(X.maximum((roe - before) / X.absolute(before), -1), 1)
    return {
        "quality_accrual": -col("accruals"), "quality_roe": roe, "quality_roe_change": X.fill(change, 0),
        "quality_roe_pct": X.fill(X.where(X.cs_count(roe) >= LEAST_RANKED, X.rank(roe), 0.5), 0.5), "value_book_to_price": col("bvps") / col("close"),
    }
