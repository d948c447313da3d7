"""The 101 published formulaic alphas as expressions. Windows given as fractions in the publication are the floored ones; every industry level is the panel's sector."""

from __future__ import annotations

from ..functions import expr as X
from ..functions.expr import Expr, col, lift

# The published formulas, in their order.
FORMULAS = {
    1: "rank(ts_argmax(signed_power(where(returns < 0, std(returns, 20), close), 2), 5)) - 0.5",
    2: "-1 * corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    3: "-1 * corr(rank(open), rank(volume), 10)",
    4: "-1 * ts_rank(rank(low), 9)",
    5: "rank(open - sum(vwap, 10) / 10) * (-1 * abs(rank(close - vwap)))",
    6: "-1 * corr(open, volume, 10)",
    7: "where(adv(20) < volume, -1 * ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)), -1)",
    8: "-1 * rank(sum(open, 5) * sum(returns, 5) - delay(sum(open, 5) * sum(returns, 5), 10))",
    9: "where(ts_min(delta(close, 1), 5) > 0, delta(close, 1), where(ts_max(delta(close, 1), 5) < 0, delta(close, 1), -1 * delta(close, 1)))",
    10: "rank(where(ts_min(delta(close, 1), 4) > 0, delta(close, 1), where(ts_max(delta(close, 1), 4) < 0, delta(close, 1), -1 * delta(close, 1))))",
    11: "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    12: "sign(delta(volume, 1)) * (-1 * delta(close, 1))",
    13: "-1 * rank(cov(rank(close), rank(volume), 5))",
    14: "-1 * rank(delta(returns, 3)) * corr(open, volume, 10)",
    15: "-1 * sum(rank(corr(rank(high), rank(volume), 3)), 3)",
    16: "-1 * rank(cov(rank(high), rank(volume), 5))",
    17: "-1 * rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / adv(20), 5))",
    18: "-1 * rank(std(abs(close - open), 5) + (close - open) + corr(close, open, 10))",
    19: "-1 * sign(close - delay(close, 7) + delta(close, 7)) * (1 + rank(1 + sum(returns, 250)))",
    20: "-1 * rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1))",
    21: "where(mean(close, 8) + std(close, 8) < mean(close, 2), -1, where(mean(close, 2) < mean(close, 8) - std(close, 8), 1, where(volume / adv(20) >= 1, 1, -1)))",
    22: "-1 * delta(corr(high, volume, 5), 5) * rank(std(close, 20))",
    23: "where(mean(high, 20) < high, -1 * delta(high, 2), 0)",
    24: "where(delta(mean(close, 100), 100) / delay(close, 100) <= 0.05, -1 * (close - ts_min(close, 100)), -1 * delta(close, 3))",
    25: "rank(-1 * returns * adv(20) * vwap * (high - close))",
    26: "-1 * ts_max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    27: "where(rank(sum(corr(rank(volume), rank(vwap), 6), 2) / 2) > 0.5, -1, 1)",
    28: "scale(corr(adv(20), low, 5) + (high + low) / 2 - close)",
    29: "ts_min(product(rank(rank(scale(log(sum(ts_min(rank(rank(-1 * rank(delta(close - 1, 5)))), 2), 1))))), 1), 5) + ts_rank(delay(-1 * returns, 6), 5)",
    30: "(1 - rank(sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3)))) * sum(volume, 5) / sum(volume, 20)",
    31: "rank(rank(rank(decay(-1 * rank(rank(delta(close, 10))), 10)))) + rank(-1 * delta(close, 3)) + sign(scale(corr(adv(20), low, 12)))",
    32: "scale(mean(close, 7) - close) + 20 * scale(corr(vwap, delay(close, 5), 230))",
    33: "rank(-1 * (1 - open / close))",
    34: "rank((1 - rank(std(returns, 2) / std(returns, 5))) + (1 - rank(delta(close, 1))))",
    35: "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))",
    36: "2.21 * rank(corr(close - open, delay(volume, 1), 15)) + 0.7 * rank(open - close) + 0.73 * rank(ts_rank(delay(-1 * returns, 6), 5)) + rank(abs(corr(vwap, adv(20), 6))) + 0.6 * rank((mean(close, 200) - open) * (close - open))",
    37: "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)",
    38: "-1 * rank(ts_rank(close, 10)) * rank(close / open)",
    39: "-1 * rank(delta(close, 7) * (1 - rank(decay(volume / adv(20), 9)))) * (1 + rank(sum(returns, 250)))",
    40: "-1 * rank(std(high, 10)) * corr(high, volume, 10)",
    41: "power(high * low, 0.5) - vwap",
    42: "rank(vwap - close) / rank(vwap + close)",
    43: "ts_rank(volume / adv(20), 20) * ts_rank(-1 * delta(close, 7), 8)",
    44: "-1 * corr(high, rank(volume), 5)",
    45: "-1 * rank(mean(delay(close, 5), 20)) * corr(close, volume, 2) * rank(corr(sum(close, 5), sum(close, 20), 2))",
    46: "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 > 0.25, -1, where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < 0, 1, -1 * (close - delay(close, 1))))",
    47: "rank(1 / close) * volume / adv(20) * (high * rank(high - close) / mean(high, 5)) - rank(vwap - delay(vwap, 5))",
    48: "neutralize(corr(delta(close, 1), delta(delay(close, 1), 1), 250) * delta(close, 1) / close) / sum(power(delta(close, 1) / delay(close, 1), 2), 250)",
    49: "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.1, 1, -1 * (close - delay(close, 1)))",
    50: "-1 * ts_max(rank(corr(rank(volume), rank(vwap), 5)), 5)",
    51: "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.05, 1, -1 * (close - delay(close, 1)))",
    52: "(-1 * ts_min(low, 5) + delay(ts_min(low, 5), 5)) * rank((sum(returns, 240) - sum(returns, 20)) / 220) * ts_rank(volume, 5)",
    53: "-1 * delta((close - low - (high - close)) / (close - low), 9)",
    54: "-1 * (low - close) * power(open, 5) / ((low - high) * power(close, 5))",
    55: "-1 * corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)",
    56: "0 - rank(sum(returns, 10) / sum(sum(returns, 2), 3)) * rank(returns)",
    57: "0 - (close - vwap) / decay(rank(ts_argmax(close, 30)), 2)",
    58: "-1 * ts_rank(decay(corr(neutralize(vwap), volume, 4), 8), 6)",
    59: "-1 * ts_rank(decay(corr(neutralize(vwap * 0.728 + vwap * 0.272), volume, 4), 16), 8)",
    60: "0 - (2 * scale(rank((close - low - (high - close)) / (high - low) * volume)) - scale(rank(ts_argmax(close, 10))))",
    61: "num(rank(vwap - ts_min(vwap, 16)) < rank(corr(vwap, adv(180), 18)))",
    62: "num(rank(corr(vwap, sum(adv(20), 22), 10)) < rank(num(rank(open) + rank(open) < rank((high + low) / 2) + rank(high)))) * -1",
    63: "(rank(decay(delta(neutralize(close), 2), 8)) - rank(decay(corr(0.318 * vwap + 0.682 * open, sum(adv(180), 37), 14), 12))) * -1",
    64: "num(rank(corr(sum(0.178 * open + 0.822 * low, 13), sum(adv(120), 13), 17)) < rank(delta(0.178 * (high + low) / 2 + 0.822 * vwap, 4))) * -1",
    65: "num(rank(corr(0.008 * open + 0.992 * vwap, sum(adv(60), 9), 6)) < rank(open - ts_min(open, 14))) * -1",
    66: "(rank(decay(delta(vwap, 4), 7)) + ts_rank(decay((0.966 * low + 0.034 * low - vwap) / (open - (high + low) / 2), 11), 7)) * -1",
    67: "power(rank(high - ts_min(high, 2)), rank(corr(neutralize(vwap), neutralize(adv(20)), 6))) * -1",
    68: "num(ts_rank(corr(rank(high), rank(adv(15)), 9), 14) < rank(delta(0.518 * close + 0.482 * low, 1))) * -1",
    69: "power(rank(ts_max(delta(neutralize(vwap), 3), 5)), ts_rank(corr(0.49 * close + 0.51 * vwap, adv(20), 5), 9)) * -1",
    70: "power(rank(delta(vwap, 1)), ts_rank(corr(neutralize(close), adv(50), 18), 18)) * -1",
    71: "max(ts_rank(decay(corr(ts_rank(close, 3), ts_rank(adv(180), 12), 18), 4), 16), ts_rank(decay(power(rank(low + open - 2 * vwap), 2), 16), 4))",
    72: "rank(decay(corr((high + low) / 2, adv(40), 9), 10)) / rank(decay(corr(ts_rank(vwap, 4), ts_rank(volume, 19), 7), 3))",
    73: "max(rank(decay(delta(vwap, 5), 3)), ts_rank(decay(-1 * (delta(0.147 * open + 0.853 * low, 2) / (0.147 * open + 0.853 * low)), 3), 17)) * -1",
    74: "num(rank(corr(close, sum(adv(30), 37), 15)) < rank(corr(rank(0.026 * high + 0.974 * vwap), rank(volume), 11))) * -1",
    75: "num(rank(corr(vwap, volume, 4)) < rank(corr(rank(low), rank(adv(50)), 12)))",
    76: "max(rank(decay(delta(vwap, 1), 12)), ts_rank(decay(ts_rank(corr(neutralize(low), adv(81), 8), 20), 17), 19)) * -1",
    77: "min(rank(decay((high + low) / 2 + high - (vwap + high), 20)), rank(decay(corr((high + low) / 2, adv(40), 3), 6)))",
    78: "power(rank(corr(sum(0.352 * low + 0.648 * vwap, 20), sum(adv(40), 20), 7)), rank(corr(rank(vwap), rank(volume), 6)))",
    79: "num(rank(delta(neutralize(0.607 * close + 0.393 * open), 1)) < rank(corr(ts_rank(vwap, 4), ts_rank(adv(150), 9), 15)))",
    80: "power(rank(sign(delta(neutralize(0.868 * open + 0.132 * high), 4))), ts_rank(corr(high, adv(10), 5), 6)) * -1",
    81: "num(rank(log(product(rank(power(rank(corr(vwap, sum(adv(10), 50), 8)), 4)), 15))) < rank(corr(rank(vwap), rank(volume), 5))) * -1",
    82: "min(rank(decay(delta(open, 1), 15)), ts_rank(decay(corr(neutralize(volume), 0.634 * open + 0.366 * open, 17), 7), 13)) * -1",
    83: "rank(delay((high - low) / mean(close, 5), 2)) * rank(rank(volume)) / ((high - low) / mean(close, 5) / (vwap - close))",
    84: "signed_power(ts_rank(vwap - ts_max(vwap, 15), 21), delta(close, 5))",
    85: "power(rank(corr(0.877 * high + 0.123 * close, adv(30), 10)), rank(corr(ts_rank((high + low) / 2, 4), ts_rank(volume, 10), 7)))",
    86: "num(ts_rank(corr(close, sum(adv(20), 15), 6), 20) < rank(open + close - (vwap + open))) * -1",
    87: "max(rank(decay(delta(0.37 * close + 0.63 * vwap, 2), 3)), ts_rank(decay(abs(corr(neutralize(adv(81)), close, 13)), 5), 14)) * -1",
    88: "min(rank(decay(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), ts_rank(decay(corr(ts_rank(close, 8), ts_rank(adv(60), 20), 8), 7), 3))",
    89: "ts_rank(decay(corr(low, adv(10), 7), 6), 4) - ts_rank(decay(delta(neutralize(vwap), 3), 10), 15)",
    90: "power(rank(close - ts_max(close, 5)), ts_rank(corr(neutralize(adv(40)), low, 5), 3)) * -1",
    91: "(ts_rank(decay(decay(corr(neutralize(close), volume, 10), 16), 4), 5) - rank(decay(corr(vwap, adv(30), 4), 3))) * -1",
    92: "min(ts_rank(decay(num((high + low) / 2 + close < low + open), 15), 19), ts_rank(decay(corr(rank(low), rank(adv(30)), 8), 7), 7))",
    93: "ts_rank(decay(corr(neutralize(vwap), adv(81), 17), 20), 8) / rank(decay(delta(0.524 * close + 0.476 * vwap, 3), 16))",
    94: "power(rank(vwap - ts_min(vwap, 12)), ts_rank(corr(ts_rank(vwap, 20), ts_rank(adv(60), 4), 18), 3)) * -1",
    95: "num(rank(open - ts_min(open, 13)) < ts_rank(power(rank(corr(sum((high + low) / 2, 19), sum(adv(40), 19), 13)), 5), 12))",
    96: "max(ts_rank(decay(corr(rank(vwap), rank(volume), 4), 4), 8), ts_rank(decay(ts_argmax(corr(ts_rank(close, 7), ts_rank(adv(60), 4), 4), 13), 14), 13)) * -1",
    97: "(rank(decay(delta(neutralize(0.721 * low + 0.279 * vwap), 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(low, 8), ts_rank(adv(60), 17), 5), 19), 16), 16)) * -1",
    98: "rank(decay(corr(vwap, sum(adv(5), 26), 5), 7)) - rank(decay(ts_rank(ts_argmin(corr(rank(open), rank(adv(15)), 21), 9), 7), 8))",
    99: "num(rank(corr(sum((high + low) / 2, 20), sum(adv(60), 20), 9)) < rank(corr(low, volume, 6))) * -1",
    100: "0 - (1.5 * scale(neutralize(neutralize(rank((close - low - (high - close)) / (high - low) * volume)))) - scale(neutralize(corr(close, rank(adv(20)), 5) - rank(ts_argmin(close, 30))))) * (volume / adv(20))",
    101: "(close - open) / (high - low + 0.001)",
}

_COLUMNS = {c: col(c) for c in ("open", "high", "low", "close", "volume", "amount", "vwap")}
NAMES = {
    **_COLUMNS, "returns": _COLUMNS["close"] / X.delay(_COLUMNS["close"], 1) - 1, "adv": lambda n: X.ts_mean(_COLUMNS["volume"], n), "num": lambda b: X.where(b, 1, 0),
    "rank": X.rank, "delay": X.delay, "delta": X.delta, "corr": X.ts_corr, "cov": X.ts_cov, "std": X.ts_std, "mean": X.ts_mean, "sum": X.ts_sum, "product": X.ts_product,
    "ts_min": X.ts_min, "ts_max": X.ts_max, "ts_rank": X.ts_rank, "ts_argmax": X.ts_argmax, "ts_argmin": X.ts_argmin, "decay": X.decay_linear, "scale": X.scale, "neutralize": X.neutralize,
    "where": X.where, "abs": X.absolute, "log": X.log, "sign": X.sign, "power": X.power, "signed_power": X.signed_power, "min": X.minimum, "max": X.maximum,
}


def formula(text: str) -> Expr:
    """The expression that a formula text states; only the names above exist in it."""
    return lift(eval(text, {"__builtins__": {}}, NAMES))  # noqa: S307  fixed texts of this library


def alphas() -> dict[str, Expr]:
    return {f"alpha_{k:03d}": formula(t) for k, t in FORMULAS.items()}
