"""A published family of 191 short-horizon price and volume factors as expressions."""

from __future__ import annotations

from ..functions import expr as X
from ..functions.expr import Expr, lift
from .alpha101 import NAMES as _NAMES

NAMES = {
    **_NAMES, "sma": X.sma, "ret": _NAMES["returns"], "before": X.delay(_NAMES["close"], 1), "eq": X.eq, "slope": X.ts_slope, "cum_sum": X.cum_sum,
    "up": _NAMES["close"] > X.delay(_NAMES["close"], 1), "down": _NAMES["close"] < X.delay(_NAMES["close"], 1), "not_up": _NAMES["close"] <= X.delay(_NAMES["close"], 1),
    "count": lambda c, n: X.ts_sum(X.where(c, 1, 0), n), "market": X.cs_mean(_NAMES["close"]), "typical": (_NAMES["high"] + _NAMES["low"] + _NAMES["close"]) / 3,
    "true_range": X.maximum(X.maximum(_NAMES["high"] - _NAMES["low"], X.absolute(X.delay(_NAMES["close"], 1) - _NAMES["high"])), X.absolute(X.delay(_NAMES["close"], 1) - _NAMES["low"])),
    # bars since the extreme, 0 for the current one
    "high_day": lambda x, n: (n - 1) - X.ts_argmax(x, n), "low_day": lambda x, n: (n - 1) - X.ts_argmin(x, n),
}

_C, _O, _H, _L = (_NAMES[n] for n in ("close", "open", "high", "low"))
_B, _BO, _BH, _BL = (X.delay(x, 1) for x in (_C, _O, _H, _L))
_MOVE = X.maximum(X.absolute(_H - _BH), X.absolute(_L - _BL))
_RISE, _FALL = _H - _BH, _BL - _L  # directional moves of the bar's ends
_PLUS = X.ts_sum(_FALL * X.where((_FALL > 0) & (_FALL > _RISE), 1, 0), 14) * 100 / X.ts_sum(NAMES["true_range"], 14)
_MINUS = X.ts_sum(_RISE * X.where((_RISE > 0) & (_RISE > _FALL), 1, 0), 14) * 100 / X.ts_sum(NAMES["true_range"], 14)


def _true_share(n: int) -> Expr:
    """The close above the summed true lows, as a share of the summed true ranges."""
    low = X.minimum(_L, _B)
    return (_C - X.ts_sum(low, n)) / X.ts_sum(X.maximum(_H, _B) - low, n)


NAMES |= {
    "exp": X.exponential, "true_share": _true_share, "swing": _C - _B + (_C - _O) / 2 + _B - _BO, "market_ret": NAMES["market"] / X.delay(NAMES["market"], 1) - 1,
    "rise_12": X.ts_sum(X.where(_H + _L > _BH + _BL, _MOVE, 0), 12), "fall_12": X.ts_sum(X.where(_H + _L < _BH + _BL, _MOVE, 0), 12),
    "gap_high": X.absolute(_H - _B), "gap_low": X.absolute(_L - _B), "gap_open": X.absolute(_B - _BO), "gap_range": X.absolute(_H - _BL),
    "open_up": X.where(_O <= _BO, 0, X.maximum(_H - _O, _O - _BO)), "open_down": X.where(_O >= _BO, 0, X.maximum(_O - _L, _O - _BO)),
    "strength": X.sma(X.maximum(_C - _B, 0), 12, 1) / X.sma(X.absolute(_C - _B), 12, 1) * 100, "directional": X.absolute(_PLUS - _MINUS) / (_PLUS + _MINUS) * 100,
    "trend": X.signed_power(_C / X.delay(_C, 19), 1 / 20) - 1,
}

# The published formulas, in their order.
FORMULAS = {
    1: "-1 * corr(rank(delta(log(volume), 1)), rank((close - open) / open), 6)",
    2: "-1 * delta((close - low - (high - close)) / (high - low), 1)",
    3: "sum(where(eq(close, before), 0, close - where(up, min(low, before), max(high, before))), 6)",
    4: "where(mean(close, 8) + std(close, 8) < mean(close, 2), -1, where(mean(close, 2) < mean(close, 8) - std(close, 8), 1, where(volume / mean(volume, 20) > 1, 1, -1)))",
    5: "-1 * ts_max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    6: "rank(sign(delta(open * 0.85 + high * 0.15, 4))) * -1",
    7: "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    8: "rank(delta((high + low) / 2 * 0.2 + vwap * 0.8, 4)) * -1",
    9: "sma(((high + low) / 2 - (delay(high, 1) + delay(low, 1)) / 2) * (high - low) / volume, 7, 2)",
    10: "rank(ts_max(power(where(ret < 0, std(ret, 20), close), 2), 5))",
    11: "sum((close - low - (high - close)) / (high - low) * volume, 6)",
    12: "rank(open - sum(vwap, 10) / 10) * (-1 * rank(abs(close - vwap)))",
    13: "power(high * low, 0.5) - vwap",
    14: "close - delay(close, 5)",
    15: "open / before - 1",
    16: "-1 * ts_max(rank(corr(rank(volume), rank(vwap), 5)), 5)",
    17: "power(rank(vwap - ts_max(vwap, 15)), delta(close, 5))",
    18: "close / delay(close, 5)",
    19: "where(close < delay(close, 5), (close - delay(close, 5)) / delay(close, 5), where(eq(close, delay(close, 5)), 0, (close - delay(close, 5)) / close))",
    20: "(close - delay(close, 6)) / delay(close, 6) * 100",
    21: "slope(mean(close, 6), 6)",
    22: "sma((close - mean(close, 6)) / mean(close, 6) - delay((close - mean(close, 6)) / mean(close, 6), 3), 12, 1)",
    23: "sma(where(up, std(close, 20), 0), 20, 1) / (sma(where(up, std(close, 20), 0), 20, 1) + sma(where(not_up, std(close, 20), 0), 20, 1)) * 100",
    24: "sma(close - delay(close, 5), 5, 1)",
    25: "-1 * rank(delta(close, 7) * (1 - rank(decay(volume / mean(volume, 20), 9)))) * (1 + rank(sum(ret, 250)))",
    26: "sum(close, 7) / 7 - close + corr(vwap, delay(close, 5), 230)",
    27: "decay((close - delay(close, 3)) / delay(close, 3) * 100 + (close - delay(close, 6)) / delay(close, 6) * 100, 12)",
    28: "3 * sma((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9)) * 100, 3, 1) - 2 * sma(sma((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9)) * 100, 3, 1), 3, 1)",
    29: "(close - delay(close, 6)) / delay(close, 6) * volume",
    30: "decay(ret * ret, 20)",
    31: "(close - mean(close, 12)) / mean(close, 12) * 100",
    32: "-1 * sum(rank(corr(rank(high), rank(volume), 3)), 3)",
    33: "(-1 * ts_min(low, 5) + delay(ts_min(low, 5), 5)) * rank((sum(ret, 240) - sum(ret, 20)) / 220) * ts_rank(volume, 5)",
    34: "mean(close, 12) / close",
    35: "min(rank(decay(delta(open, 1), 15)), rank(decay(corr(volume, open * 0.65 + open * 0.35, 17), 7))) * -1",
    36: "rank(sum(corr(rank(volume), rank(vwap), 6), 2))",
    37: "-1 * rank(sum(open, 5) * sum(ret, 5) - delay(sum(open, 5) * sum(ret, 5), 10))",
    38: "where(mean(high, 20) < high, -1 * delta(high, 2), 0)",
    39: "(rank(decay(delta(close, 2), 8)) - rank(decay(corr(vwap * 0.3 + open * 0.7, sum(mean(volume, 180), 37), 14), 12))) * -1",
    40: "sum(where(up, volume, 0), 26) / sum(where(not_up, volume, 0), 26) * 100",
    41: "rank(ts_max(delta(vwap, 3), 5)) * -1",
    42: "-1 * rank(std(high, 10)) * corr(high, volume, 10)",
    43: "sum(where(up, volume, where(down, -1 * volume, 0)), 6)",
    44: "ts_rank(decay(corr(low, mean(volume, 10), 7), 6), 4) + ts_rank(decay(delta(vwap, 3), 10), 15)",
    45: "rank(delta(close * 0.6 + open * 0.4, 1)) * rank(corr(vwap, mean(volume, 150), 15))",
    46: "(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24)) / (4 * close)",
    47: "sma((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6)) * 100, 9, 1)",
    48: "-1 * rank(sign(close - before) + sign(before - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))) * sum(volume, 5) / sum(volume, 20)",
    49: "fall_12 / (fall_12 + rise_12)",
    50: "rise_12 / (rise_12 + fall_12) - fall_12 / (rise_12 + fall_12)",
    51: "rise_12 / (rise_12 + fall_12)",
    52: "sum(max(0, high - delay(typical, 1)), 26) / sum(max(0, delay(typical, 1) - low), 26) * 100",
    53: "count(up, 12) / 12 * 100",
    54: "-1 * rank(std(abs(close - open), 10) + (close - open) + corr(close, open, 10))",
    55: "sum(16 * swing / where((gap_high > gap_low) & (gap_high > gap_range), gap_high + gap_low / 2 + gap_open / 4, gap_low + gap_high / 2 + gap_open / 4) * max(gap_high, gap_low), 20)",
    56: "num(rank(open - ts_min(open, 12)) < rank(power(rank(corr(sum((high + low) / 2, 19), sum(mean(volume, 40), 19), 13)), 5)))",
    57: "sma((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9)) * 100, 3, 1)",
    58: "count(up, 20) / 20 * 100",
    59: "sum(where(eq(close, before), 0, close - where(up, min(low, before), max(high, before))), 20)",
    60: "sum((close - low - (high - close)) / (high - low) * volume, 20)",
    61: "max(rank(decay(delta(vwap, 1), 12)), rank(decay(rank(corr(low, mean(volume, 80), 8)), 17))) * -1",
    62: "-1 * corr(high, rank(volume), 5)",
    63: "sma(max(close - before, 0), 6, 1) / sma(abs(close - before), 6, 1) * 100",
    64: "max(rank(decay(corr(rank(vwap), rank(volume), 4), 4)), rank(decay(ts_max(corr(rank(close), rank(mean(volume, 60)), 4), 13), 14))) * -1",
    65: "mean(close, 6) / close",
    66: "(close - mean(close, 6)) / mean(close, 6) * 100",
    67: "sma(max(close - before, 0), 24, 1) / sma(abs(close - before), 24, 1) * 100",
    68: "sma(((high + low) / 2 - (delay(high, 1) + delay(low, 1)) / 2) * (high - low) / volume, 15, 2)",
    69: "where(sum(open_up, 20) > sum(open_down, 20), (sum(open_up, 20) - sum(open_down, 20)) / sum(open_up, 20), where(sum(open_up, 20) < sum(open_down, 20), (sum(open_up, 20) - sum(open_down, 20)) / sum(open_down, 20), 0))",
    70: "std(amount, 6)",
    71: "(close - mean(close, 24)) / mean(close, 24) * 100",
    72: "sma((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6)) * 100, 15, 1)",
    73: "(ts_rank(decay(decay(corr(close, volume, 10), 16), 4), 5) - rank(decay(corr(vwap, mean(volume, 30), 4), 3))) * -1",
    74: "rank(corr(sum(low * 0.35 + vwap * 0.65, 20), sum(mean(volume, 40), 20), 7)) + rank(corr(rank(vwap), rank(volume), 6))",
    75: "count((close > open) & (market < delay(market, 1)), 50) / count(market < delay(market, 1), 50)",
    76: "std(abs(close / before - 1) / volume, 20) / mean(abs(close / before - 1) / volume, 20)",
    77: "min(rank(decay((high + low) / 2 + high - (vwap + high), 20)), rank(decay(corr((high + low) / 2, mean(volume, 40), 3), 6)))",
    78: "(typical - mean(typical, 12)) / (0.015 * mean(abs(close - mean(typical, 12)), 12))",
    79: "sma(max(close - before, 0), 12, 1) / sma(abs(close - before), 12, 1) * 100",
    80: "(volume - delay(volume, 5)) / delay(volume, 5) * 100",
    81: "sma(volume, 21, 2)",
    82: "sma((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6)) * 100, 20, 1)",
    83: "-1 * rank(cov(rank(high), rank(volume), 5))",
    84: "sum(where(up, volume, where(down, -1 * volume, 0)), 20)",
    85: "ts_rank(volume / mean(volume, 20), 20) * ts_rank(-1 * delta(close, 7), 8)",
    86: "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 > 0.25, -1, where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < 0, 1, -1 * (close - before)))",
    87: "(rank(decay(delta(vwap, 4), 7)) + ts_rank(decay((low * 0.9 + low * 0.1 - vwap) / (open - (high + low) / 2), 11), 7)) * -1",
    88: "(close - delay(close, 20)) / delay(close, 20) * 100",
    89: "2 * (sma(close, 13, 2) - sma(close, 27, 2) - sma(sma(close, 13, 2) - sma(close, 27, 2), 10, 2))",
    90: "-1 * rank(corr(rank(vwap), rank(volume), 5))",
    91: "-1 * rank(close - ts_max(close, 5)) * rank(corr(mean(volume, 40), low, 5))",
    92: "max(rank(decay(delta(close * 0.35 + vwap * 0.65, 2), 3)), ts_rank(decay(abs(corr(mean(volume, 180), close, 13)), 5), 15)) * -1",
    93: "sum(where(open >= delay(open, 1), 0, max(open - low, open - delay(open, 1))), 20)",
    94: "sum(where(up, volume, where(down, -1 * volume, 0)), 30)",
    95: "std(amount, 20)",
    96: "sma(sma((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9)) * 100, 3, 1), 3, 1)",
    97: "std(volume, 10)",
    98: "where(delta(mean(close, 100), 100) / delay(close, 100) <= 0.05, -1 * (close - ts_min(close, 100)), -1 * delta(close, 3))",
    99: "-1 * rank(cov(rank(close), rank(volume), 5))",
    100: "std(volume, 20)",
    101: "num(rank(corr(close, sum(mean(volume, 30), 37), 15)) < rank(corr(rank(high), rank(mean(volume, 10)), 11))) * -1",
    102: "sma(max(volume - delay(volume, 1), 0), 6, 1) / sma(abs(volume - delay(volume, 1)), 6, 1) * 100",
    103: "(20 - low_day(low, 20)) / 20 * 100",
    104: "-1 * delta(corr(high, volume, 5), 5) * rank(std(close, 20))",
    105: "-1 * corr(rank(open), rank(volume), 10)",
    106: "close - delay(close, 20)",
    107: "-1 * rank(open - delay(high, 1)) * rank(open - before) * rank(open - delay(low, 1))",
    108: "power(rank(high - ts_min(high, 2)), rank(corr(vwap, mean(volume, 120), 6))) * -1",
    109: "sma(high - low, 10, 2) / sma(sma(high - low, 10, 2), 10, 2)",
    110: "sum(max(0, high - before), 20) / sum(max(0, before - low), 20) * 100",
    111: "sma(volume * (close - low - (high - close)) / (high - low), 11, 2) - sma(volume * (close - low - (high - close)) / (high - low), 4, 2)",
    112: "(sum(where(up, close - before, 0), 12) - sum(where(down, before - close, 0), 12)) / (sum(where(up, close - before, 0), 12) + sum(where(down, before - close, 0), 12)) * 100",
    113: "-1 * rank(mean(delay(close, 5), 20)) * corr(close, volume, 2) * rank(corr(sum(close, 5), sum(close, 20), 2))",
    114: "rank(delay((high - low) / (sum(close, 5) / 5), 2)) * rank(rank(volume)) / ((high - low) / (sum(close, 5) / 5) / (vwap - close))",
    115: "power(rank(corr(high * 0.9 + close * 0.1, mean(volume, 30), 10)), rank(corr(ts_rank((high + low) / 2, 4), ts_rank(volume, 10), 7)))",
    116: "slope(close, 20)",
    117: "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(ret, 32))",
    118: "sum(high - open, 20) / sum(open - low, 20) * 100",
    119: "rank(decay(corr(vwap, sum(mean(volume, 5), 26), 5), 7)) - rank(decay(ts_rank(ts_min(corr(rank(open), rank(mean(volume, 15)), 21), 9), 7), 8))",
    120: "rank(vwap - close) / rank(vwap + close)",
    121: "power(rank(vwap - ts_min(vwap, 12)), ts_rank(corr(ts_rank(vwap, 20), ts_rank(mean(volume, 60), 2), 18), 3)) * -1",
    122: "sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2) / delay(sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2), 1) - 1",
    123: "num(rank(corr(sum((high + low) / 2, 20), sum(mean(volume, 60), 20), 9)) < rank(corr(low, volume, 6))) * -1",
    124: "(close - vwap) / decay(rank(ts_max(close, 30)), 2)",
    125: "rank(decay(corr(vwap, mean(volume, 80), 17), 20)) / rank(decay(delta(close * 0.5 + vwap * 0.5, 3), 16))",
    126: "typical",
    127: "power(mean(power(100 * (close - ts_max(close, 12)) / ts_max(close, 12), 2), 12), 0.5)",
    128: "100 - 100 / (1 + sum(where(typical > delay(typical, 1), typical * volume, 0), 14) / sum(where(typical < delay(typical, 1), typical * volume, 0), 14))",
    129: "sum(where(down, abs(close - before), 0), 12)",
    130: "rank(decay(corr((high + low) / 2, mean(volume, 40), 9), 10)) / rank(decay(corr(rank(vwap), rank(volume), 7), 3))",
    131: "power(rank(delta(vwap, 1)), ts_rank(corr(close, mean(volume, 50), 18), 18))",
    132: "mean(amount, 20)",
    133: "(20 - high_day(high, 20)) / 20 * 100 - (20 - low_day(low, 20)) / 20 * 100",
    134: "(close - delay(close, 12)) / delay(close, 12) * volume",
    135: "sma(delay(close / delay(close, 20), 1), 20, 1)",
    136: "-1 * rank(delta(ret, 3)) * corr(open, volume, 10)",
    137: "16 * swing / where((gap_high > gap_low) & (gap_high > gap_range), gap_high + gap_low / 2 + gap_open / 4, where((gap_low > gap_range) & (gap_low > gap_high), gap_low + gap_high / 2 + gap_open / 4, gap_range + gap_open / 4)) * max(gap_high, gap_low)",
    138: "(rank(decay(delta(low * 0.7 + vwap * 0.3, 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(low, 8), ts_rank(mean(volume, 60), 17), 5), 19), 16), 7)) * -1",
    139: "-1 * corr(open, volume, 10)",
    140: "min(rank(decay(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), ts_rank(decay(ts_rank(corr(ts_rank(close, 8), ts_rank(mean(volume, 60), 20), 8), 7), 7), 3))",
    141: "rank(corr(rank(high), rank(mean(volume, 15)), 9)) * -1",
    142: "-1 * rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / mean(volume, 20), 5))",
    143: "exp(cum_sum(log(1 + where(up, ret, 0))))",
    144: "sum(abs(ret) / amount * num(down), 20) / count(down, 20)",
    145: "(mean(volume, 9) - mean(volume, 26)) / mean(volume, 12) * 100",
    146: "mean(ret - sma(ret, 61, 2), 20) * (ret - sma(ret, 61, 2)) / sma(power(ret - sma(ret, 61, 2), 2), 60, 2)",
    147: "slope(mean(close, 12), 12)",
    148: "num(rank(corr(open, sum(mean(volume, 60), 9), 6)) < rank(open - ts_min(open, 14))) * -1",
    149: "cov(ret * num(market < delay(market, 1)), (market / delay(market, 1) - 1) * num(market < delay(market, 1)), 20) / power(std((market / delay(market, 1) - 1) * num(market < delay(market, 1)), 20), 2)",
    150: "typical * volume",
    151: "sma(close - delay(close, 20), 20, 1)",
    152: "sma(mean(delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1), 12) - mean(delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1), 26), 9, 1)",
    153: "(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24)) / 4",
    154: "num(vwap - ts_min(vwap, 16) < corr(vwap, mean(volume, 180), 18)) * -1",
    155: "sma(volume, 13, 2) - sma(volume, 27, 2) - sma(sma(volume, 13, 2) - sma(volume, 27, 2), 10, 2)",
    156: "max(rank(decay(delta(vwap, 5), 3)), rank(decay(-1 * delta(open * 0.15 + low * 0.85, 2) / (open * 0.15 + low * 0.85), 3))) * -1",
    157: "ts_min(rank(rank(log(sum(ts_min(rank(rank(-1 * rank(delta(close - 1, 5)))), 2), 1)))), 5) + ts_rank(delay(-1 * ret, 6), 5)",
    158: "(high - sma(close, 15, 2) - (low - sma(close, 15, 2))) / close",
    159: "(true_share(6) * 12 * 24 + true_share(12) * 6 * 24 + true_share(24) * 6 * 12) / (6 * 12 + 6 * 24 + 12 * 24) * 100",
    160: "sma(where(not_up, std(close, 20), 0), 20, 1)",
    161: "mean(true_range, 12)",
    162: "(strength - ts_min(strength, 12)) / (ts_max(strength, 12) - ts_min(strength, 12))",
    163: "rank(-1 * ret * mean(volume, 20) * vwap * (high - close))",
    164: "sma((where(up, 1 / (close - before), 1) - ts_min(where(up, 1 / (close - before), 1), 12)) / (high - low) * 100, 13, 2)",
    165: "(ts_max(sum(close - mean(close, 48), 48), 48) - ts_min(sum(close - mean(close, 48), 48), 48)) / std(close, 48)",
    166: "-20 * 19 ** 1.5 * sum(ret - mean(ret, 20), 20) / (19 * 18 * power(sum(ret * ret, 20), 1.5))",
    167: "sum(max(0, close - before), 12)",
    168: "-1 * volume / mean(volume, 20)",
    169: "sma(mean(delay(sma(close - before, 9, 1), 1), 12) - mean(delay(sma(close - before, 9, 1), 1), 26), 10, 1)",
    170: "rank(1 / close) * volume / mean(volume, 20) * (high * rank(high - close) / (sum(close, 5) / 5)) - rank(vwap - delay(vwap, 5))",
    171: "-1 * (low - close) * power(open, 5) / ((close - high) * power(close, 5))",
    172: "mean(directional, 6)",
    173: "3 * sma(close, 13, 2) - 2 * sma(sma(close, 13, 2), 13, 2) + sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2)",
    174: "sma(where(up, std(close, 20), 0), 20, 1)",
    175: "mean(true_range, 6)",
    176: "corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)",
    177: "(20 - high_day(high, 20)) / 20 * 100",
    178: "(close - before) / before * volume",
    179: "rank(corr(vwap, volume, 4)) * rank(corr(rank(low), rank(mean(volume, 50)), 12))",
    180: "-1 * ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)) * num(mean(volume, 20) < volume) - volume * (1 - num(mean(volume, 20) < volume))",
    181: "sum(ret - mean(ret, 20) - power(market_ret - mean(market_ret, 20), 2), 20) / sum(power(market_ret - mean(market_ret, 20), 3), 20)",
    182: "count(((close > open) & (market > delay(market, 1))) | ((close < open) & (market < delay(market, 1))), 20) / 20",
    183: "(ts_max(sum(close - mean(close, 24), 24), 24) - ts_min(sum(close - mean(close, 24), 24), 24)) / std(close, 24)",
    184: "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)",
    185: "rank(-1 * power(1 - open / close, 2))",
    186: "(mean(directional, 6) + delay(mean(directional, 6), 6)) / 2",
    187: "sum(max(high - open, open - delay(open, 1)) * (1 - num(open <= delay(open, 1))), 20)",
    188: "(high - low - sma(high - low, 11, 2)) / sma(high - low, 11, 2) * 100",
    189: "mean(abs(close - mean(close, 6)), 6)",
    190: "log((count(ret > trend, 20) - 1) * sum(power(ret - trend, 2) * num(ret < trend), 20) / (count(ret < trend, 20) * sum(power(ret - trend, 2) * num(ret > trend), 20)))",
    191: "corr(mean(volume, 20), low, 5) + (high + low) / 2 - close",
}


def factors() -> dict[str, Expr]:
    return {f"short_{k:03d}": lift(eval(t, {"__builtins__": {}}, NAMES)) for k, t in FORMULAS.items()}  # noqa: S307  fixed texts of this library
