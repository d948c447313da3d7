"""Candlestick patterns, channels and clouds as expressions: rules over a bar and its one or two predecessors, and finite windows."""

from __future__ import annotations

from ..functions import expr as X
from ..functions.expr import Expr, col

#: Shadow over body of a hammer; body over range of a doji and of a small body (fixed values).
SHADOW, DOJI, SMALL = 2.0, 0.1, 0.3


def _bar(k: int) -> tuple[Expr, Expr, Expr, Expr]:
    """Open, high, low and close, k bars ago."""
    return tuple(X.delay(col(c), k) if k else col(c) for c in ("open", "high", "low", "close"))


def patterns() -> dict[str, Expr]:
    """1, -1 or 0 for each pattern, and `candle`: the sign of their sum. A bar without the predecessors that a rule needs has no pattern. Doji and spinning tops give no direction."""
    o, h, low, c = _bar(0)
    o1, h1, l1, c1 = _bar(1)
    o2, h2, l2, c2 = _bar(2)
    body, span = X.absolute(c - o), h - low
    upper, lower = h - X.maximum(o, c), X.minimum(o, c) - low
    rises, falls = c > o, c < o
    rose, fell = c1 > o1, c1 < o1
    flag = lambda rule, value=1: X.where(rule, value, 0)
    either = lambda up, down: X.where(up, 1, X.where(down, -1, 0))
    small1 = X.absolute(c1 - o1) / (h1 - l1) < SMALL  # a bar without a range has no ratio
    middle1, middle2 = (o1 + c1) / 2, (o2 + c2) / 2
    inside = (X.maximum(o, c) <= X.maximum(o1, c1)) & (X.minimum(o, c) >= X.minimum(o1, c1)) & (X.absolute(c1 - o1) > body)
    inverted = (upper >= body * SHADOW) & (lower < body) & (body > 0)
    found = {
        "hammer": flag((lower >= body * SHADOW) & (upper < body) & (body > 0) & (span > 0)),
        "inverted_hammer": flag(inverted),
        "shooting_star": flag(inverted & (c1 > c2), -1),
        "engulfing": either(fell & rises & (c >= o1) & (o <= c1), rose & falls & (c <= o1) & (o >= c1)),
        "harami": either(fell & inside, rose & inside),
        "piercing_line": flag(fell & rises & (o < l1) & (c > middle1)),
        "dark_cloud": flag(rose & falls & (o > h1) & (c < middle1), -1),
        "morning_star": flag((c2 < o2) & small1 & (h1 < l2) & rises & (c > middle2)),
        "evening_star": flag((c2 > o2) & small1 & (l1 > h2) & falls & (c < middle2), -1),
        "three_white_soldiers": flag((c2 > o2) & rose & rises & (c1 > c2) & (c > c1) & (o1 >= o2) & (o1 <= c2) & (o >= o1) & (o <= c1)),
        "three_black_crows": flag((c2 < o2) & fell & falls & (c1 < c2) & (c < c1) & (o1 <= o2) & (o1 >= c2) & (o <= o1) & (o >= c1), -1),
    }
    total = sum(found.values(), X.lift(0))
    ratio = body / span
    is_doji = ratio < DOJI
    return found | {"doji": flag(is_doji), "spinning_top": X.where(is_doji, 0, flag((ratio < SMALL) & (upper > body) & (lower > body))), "candle": X.sign(total)}


def donchian(n: int = 20) -> dict[str, Expr]:
    """Channel of the last n bars and its middle."""
    top, bottom = X.ts_max(col("high"), n), X.ts_min(col("low"), n)
    return {"donchian_up": top, "donchian_low": bottom, "donchian_mid": (top + bottom) / 2}


def ichimoku(fast: int = 9, slow: int = 26, span: int = 52) -> dict[str, Expr]:
    """Lines and the cloud known now (of `slow` bars ago); signal 1 or -1 where the fast line crosses the slow one on the cloud's side of the close, and the cloud points that way."""
    mid = lambda n: (X.ts_max(col("high"), n) + X.ts_min(col("low"), n)) / 2
    tenkan, kijun = mid(fast), mid(slow)
    a, b = X.delay((tenkan + kijun) / 2, slow), X.delay(mid(span), slow)
    c = col("close")
    before = X.delay(tenkan - kijun, 1)
    up = (tenkan > kijun) & (before <= 0) & (c > X.maximum(a, b)) & (a > b)
    down = (tenkan < kijun) & (before >= 0) & (c < X.minimum(a, b)) & (a < b)
    return {"tenkan": tenkan, "kijun": kijun, "cloud_a": a, "cloud_b": b, "ichimoku": X.where(up, 1, X.where(down, -1, 0))}


def volatility_percentile(n: int = 20, lookback: int = 120, low: float = 20.0, high: float = 80.0) -> dict[str, Expr]:
    """Annual volatility of n log returns, its percentile among the last `lookback`, and the reverting signal: 1 where it is low, -1 where it is high."""
    hv = X.ts_std(X.log(col("close") / X.delay(col("close"), 1)), n) * 252**0.5
    place = X.ts_rank(hv, lookback) * 100
    return {"hv": hv, "hv_percentile": place, "hv_signal": X.where(place < low, 1, X.where(place > high, -1, 0))}


def running_prices() -> dict[str, Expr]:
    """Volume-weighted and time-weighted mean price since a series began."""
    typical = (col("high") + col("low") + col("close")) / 3
    one = X.where(col("close") > 0, 1, 1)
    return {"vwap_run": X.cum_sum(typical * col("volume")) / X.cum_sum(col("volume")), "twap_run": X.cum_sum(col("close")) / X.cum_sum(one)}
