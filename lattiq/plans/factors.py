"""Factor families that follow from rules: window features, bar shapes, academic anomalies."""

from __future__ import annotations

from ..functions import expr as X
from ..functions.expr import Expr, absolute, col, delay, log, safe_div, where

O, H, L, C, V, VWAP = (col(c) for c in ("open", "high", "low", "close", "volume", "vwap"))
WINDOWS = (5, 10, 20, 30, 60)


def bar_shapes() -> dict[str, Expr]:
    top, bottom, span = X.maximum(O, C), X.minimum(O, C), H - L
    parts = {"mid": C - O, "up": H - top, "low": bottom - L, "sft": C * 2 - H - L}
    out = {"klen": safe_div(span, O)}
    for name, part in parts.items():
        out[f"k{name}"] = safe_div(part, O)
        out[f"k{name}2"] = safe_div(part, span)
    return out


def window_features(n: int) -> dict[str, Expr]:
    """The 29 features of one window length."""
    before = delay(C, 1)
    step, vstep = C - before, V - delay(V, 1)
    up, down = where(C > before, 1, 0), where(C < before, 1, 0)

    def shares(d: Expr, name: str) -> dict[str, Expr]:
        # a missing first step counts as no move up or down, but is missing in the sum of moves
        gain, loss, moved = (X.ts_sum(x, n) for x in (where(d > 0, d, 0), where(d < 0, -d, 0), absolute(d)))
        return {f"{name}p{n}": safe_div(gain, moved), f"{name}n{n}": safe_div(loss, moved), f"{name}d{n}": safe_div(gain - loss, moved)}

    high, low = X.ts_max(H, n), X.ts_min(L, n)
    growth = log((V + 1) / (delay(V, 1) + 1))
    ret = safe_div(C, before) - 1
    fit = X.ts_corr(C, X.row_index, n)
    return {
        f"roc{n}": safe_div(C, delay(C, n)) - 1, f"ma{n}": safe_div(X.ts_mean(C, n), C), f"std{n}": safe_div(X.ts_std(C, n), C), f"beta{n}": safe_div(safe_div(X.delta(C, n), C), X.lift(n)),
        f"rsqr{n}": fit * fit, f"resi{n}": safe_div(C - X.ts_mean(C, n), C), f"max{n}": safe_div(high, C), f"min{n}": safe_div(low, C),
        f"qtlu{n}": safe_div(X.ts_quantile(C, n, 0.8), C), f"qtld{n}": safe_div(X.ts_quantile(C, n, 0.2), C), f"rank{n}": X.ts_rank(C, n), f"rsv{n}": safe_div(C - low, high - low),
        f"imax{n}": X.ts_argmax(H, n) / n, f"imin{n}": X.ts_argmin(L, n) / n, f"imxd{n}": (X.ts_argmax(H, n) - X.ts_argmin(L, n)) / n,
        f"corr{n}": X.ts_corr(C, log(V + 1), n), f"cord{n}": X.ts_corr(safe_div(C, before), growth, n),
        f"cntp{n}": X.ts_mean(up, n), f"cntn{n}": X.ts_mean(down, n), f"cntd{n}": X.ts_mean(up, n) - X.ts_mean(down, n),
        **shares(step, "sum"), f"vma{n}": safe_div(X.ts_mean(V, n), V + 1e-12), f"vstd{n}": safe_div(X.ts_std(V, n), V + 1e-12),
        f"wvma{n}": safe_div(X.ts_std(ret * V, n), X.ts_mean(absolute(ret) * V, n)), **shares(vstep, "vsum"),
    }


def academic() -> dict[str, Expr]:
    """Published anomalies, as per-date z-scores."""
    growth = lambda d: safe_div(C - delay(C, d), delay(C, d))
    ret = growth(1)
    found = {
        "carhart_mom": growth(252) - growth(21), "cma": -X.delta(log(X.ts_mean(V, 60) + 1), 60), "high52w": safe_div(C, X.ts_max(C, 252)), "hml": -growth(252),
        "illiq": X.ts_mean(safe_div(absolute(ret), C * V), 21), "mkt_rf": growth(21), "retskew": -X.ts_skew(ret, 60), "rmw": -X.ts_std(ret, 60),
        "smb": -log(X.ts_mean(V * C, 60) + 1), "strev": -growth(21),
    }
    return {k: X.cs_zscore(e) for k, e in found.items()}


def daily_set() -> dict[str, Expr]:
    """Daily factors of momentum, reversal, risk, liquidity, trend, place and volume. Residual volatility takes the beta to the mean return of all codes over the last 250 rows, so nothing is known early; full windows only."""
    amount = col("amount")
    past = lambda d: safe_div(C, delay(C, d)) - 1
    ret, volume_ret = past(1), safe_div(V, delay(V, 1)) - 1
    market = X.cs_mean(ret)
    beta = safe_div(X.ts_cov(ret, market, 250), X.ts_std(market, 250) * X.ts_std(market, 250))
    fall, rise = where(ret < 0, ret, 0), where(ret > 0, ret, 0)
    mean20, mean60 = X.ts_mean(C, 20), X.ts_mean(C, 60)
    found = {f"mom_{d}": past(d) for d in (5, 20, 60, 120, 250)} | {f"rev_{d}": -past(d) for d in (5, 20, 60)}
    return found | {
        "mom_12_1": safe_div(delay(C, 21), delay(C, 252)) - 1, "rev_intraday": -safe_div(C - O, O), "rev_rank": X.rank(-past(20)), "vol_20": X.ts_std(ret, 20), "vol_60": X.ts_std(ret, 60), "ret_skew_60": X.ts_skew(ret, 60),
        "ivol_60": X.ts_std(ret - beta * market, 60), "amihud_20": X.ts_mean(safe_div(absolute(ret), amount), 20), "dolvol_trend": safe_div(amount, X.ts_mean(amount, 20)) - 1,
        "ma_dev_20": safe_div(C, mean20) - 1, "ma_dev_60": safe_div(C, mean60) - 1, "rsi_14": 1 - safe_div(1, 1 + safe_div(X.ts_mean(rise, 14), X.ts_mean(-fall, 14) + 1e-12)), "boll_w": safe_div(X.ts_std(C, 20) * 4, mean20),
        "high_52w": safe_div(C, X.ts_max(C, 252)) - 1, "overnight_gap": safe_div(O, delay(C, 1)) - 1, "intraday_range": safe_div(H - L, C), "downside_vol_60": X.ts_std(fall, 60), "drawup_60": safe_div(X.ts_max(C, 60), C) - 1,
        "vol_ratio": safe_div(V, X.ts_mean(V, 20)), "vol_price_corr": X.ts_corr(ret, volume_ret, 20), "amount_strength": safe_div(amount, X.ts_mean(amount, 60)) - 1,
    }
