"""What markets charge and allow, as column expressions: kinds of symbols, contract terms, fees, lots, slippage, price limits, funding, liquidation and swaps. Rows need no order but for once-a-day charges, which are one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values. Forms of symbols, in this order, those of currencies in capitals; what fits none is an A share.
FORMS = (
    (r"(?i)^\d{6}\.(SZ|SH|BJ)$", "a_share"), (r"(?i)^[A-Z]+\.US$", "us_equity"), (r"(?i)^\d{3,5}\.HK$", "hk_equity"), (r"(?i)^[A-Z]+[-/]USDT$", "crypto"), (r"(?i)^[A-Z]{1,2}\d{3,4}\.(ZCE|DCE|SHFE|INE|CFFEX|GFEX)$", "futures"),
    (r"(?i)^[A-Z]{2,4}[FGHJKMNQUVXZ]\d{1,2}$", "futures"), (r"(?i)^[A-Z]{2,4}\d{4}$", "futures"), (r"(?i)^[A-Z]{2,4}\.(CME|CBOT|NYMEX|COMEX|ICE|EUREX)$", "futures"), (r"^[A-Z]{3}/[A-Z]{3}$", "forex"), (r"^[A-Z]{6}\.FX$", "forex"),
)
# Products whose symbols name no exchange.
CHINA_PRODUCTS = "if ic ih im t tf ts tl au ag cu al zn pb ni sn ss rb hc i j jm sc fu lu bu nr c cs m y a p jd lh cf sr ta ma ap rm oi pp l v eg eb pf sa fg ur si lc"
CHINA_EXCHANGES = ("CFFEX", "SHFE", "DCE", "ZCE", "INE", "GFEX")

# Product, multiplier, margin rate, price limit, fee by notional, fee by lot; - takes the default below.
CHINA_CONTRACTS = """
IF 300 0.12 0.10 0.000023 -
IC 200 0.12 0.10 0.000023 -
IH 300 0.12 0.10 0.000023 -
IM 200 0.12 0.10 0.000023 -
T 10000 0.03 0.02 - 3.0
TF 10000 0.02 0.012 - 3.0
TS 20000 0.015 0.005 - 3.0
TL 10000 0.035 0.035 - -
au 1000 0.08 - - 10.0
ag 15 0.09 - - 3.0
cu 5 0.08 - - 5.0
al 5 0.07 - - 3.0
zn 5 0.08 - - 3.0
pb 5 0.08 - - -
ni 1 0.12 - - 3.0
sn 1 0.10 - - -
ss 5 0.08 - - -
rb 10 0.10 - 0.0001 -
hc 10 0.10 - 0.0001 -
i 100 0.12 - 0.0001 -
j 100 0.12 - 0.0001 -
jm 60 0.12 - 0.0001 -
sc 1000 0.10 - - 20.0
fu 10 0.10 - 0.00005 -
c 10 0.07 - - 1.2
cs 10 0.07 - - 1.5
m 10 0.08 - - 1.5
y 10 0.08 - - 2.5
a 10 0.08 - - 2.0
p 10 0.08 - - 2.5
jd 10 0.08 - 0.00015 -
lh 16 0.12 - 0.0002 -
CF 5 0.07 - - 4.3
SR 10 0.07 - - 3.0
TA 5 0.07 - - 3.0
MA 10 0.07 - - 2.0
pp 5 0.07 - - 1.0
l 5 0.07 - - 1.0
v 5 0.07 - - 1.0
eg 10 0.08 - - -
eb 5 - - - -
CJ 5 - - - -
PK 5 - - - -
CY 5 - - - -
PF 5 - - - -
SA 20 0.08 - - 3.5
FG 20 0.08 - - 3.0
UR 20 0.08 - - -
pg 20 - - - -
si 5 - - - -
lc 1 - - - -
"""
CHINA_DEFAULTS = (10.0, 0.10, 0.05, 0.0, 5.0)
# Product, multiplier, margin of a contract, price limit, fee of a contract.
GLOBAL_CONTRACTS = """
ES 50 12650 0.07 2.25
NQ 20 17600 0.07 2.25
YM 5 8800 0.07 2.25
RTY 50 6600 0.07 2.25
MES 5 1265 0.07 0.62
MNQ 2 1760 0.07 0.62
CL 1000 6270 - 2.25
NG 10000 3300 - 2.25
RB 42000 - - -
HO 42000 - - -
GC 100 9950 - 2.25
SI 5000 11000 - 2.25
HG 25000 4400 - 2.25
PL 50 3300 - -
MGC 10 995 - 0.62
ZC 50 1650 - 2.25
ZS 50 2200 - 2.25
ZW 50 1925 - 2.25
ZM 100 - - -
ZL 600 - - -
ZB 1000 4400 - 1.52
ZN 1000 2200 - 1.52
ZF 1000 1375 - 1.02
ZT 2000 - - -
MYM 0.5 - - -
M2K 5 - - -
PA 100 - - -
SIL 1000 - - -
6E 125000 2475 - 2.25
6J 12500000 3300 - 2.25
6B 62500 2750 - 2.25
6A 100000 - - -
6C 100000 - - -
KC 37500 - - -
SB 112000 - - -
CC 10 - - -
CT 50000 - - -
LE 400 - - -
HE 400 - - -
GF 500 - - -
FESX 10 - - -
FDAX 25 - - -
FGBL 1000 - - -
"""
GLOBAL_DEFAULTS = (50.0, None, None, 2.5)
# Largest notional of a tier and its maintenance rate; rate beyond.
TIERS, BEYOND = ((100_000, 0.004), (500_000, 0.006), (1_000_000, 0.01), (5_000_000, 0.02), (10_000_000, 0.05)), 0.10
FUNDING_HOURS = (0, 8, 16)
# Pair, spread in pips, swap a lot and day of longs and of shorts.
PAIRS = (("EUR/USD", 1.0, -6.5, 3.5), ("GBP/USD", 1.2, -3.0, -1.0), ("USD/JPY", 1.0, 8.0, -12.0), ("USD/CHF", 1.3, 4.0, -8.0), ("AUD/USD", 1.2, -2.0, -1.0), ("USD/CAD", 1.5, 2.0, -5.0), ("NZD/USD", 1.5, -1.5, -2.0))
PAIR_DEFAULTS, LOT, EXTRA_PIPS = (2.0, -1.0, -1.0), 100_000, 0.3
# Hong Kong's commission, stamp tax, levies and settlement fee; slippage of Hong Kong and of the United States.
HK_FEES, HK_SLIP, US_SLIP = (0.00015, 0.001, 0.0000565, 0.00002), 0.001, 0.0005
# First digits of boards with a limit of their own; six digits starting with 8 have the last.
BOARD_LIMITS, BEIJING_LIMIT, BOARD_LIMIT = (("300", 0.20), ("688", 0.20)), 0.30, 0.10


def market_of(symbol: Column) -> Column:
    out = F.lit("a_share")
    for form, market in reversed(FORMS):
        out = F.when(symbol.rlike(form), market).otherwise(out)
    return out


def _rows(text: str, defaults: tuple) -> list[tuple]:
    found = {}
    for line in text.split("\n"):
        if line:
            product, *terms = line.split()
            found[product] = (product, *(d if t == "-" else float(t) for t, d in zip(terms, defaults, strict=True)))
    # a product with a fee by notional pays none by lot
    return [(*r[:5], 0.0) if len(r) == 6 and r[4] else r for r in found.values()]


def is_china_future(symbol: Column) -> Column:
    """By the exchange after the point; without one, letters before digits that are a Chinese product in either case."""
    s = F.upper(symbol)
    named = F.split(s, r"\.")
    bare = F.regexp_extract(s, r"^([A-Z]+)\d+", 1).isin(CHINA_PRODUCTS.upper().split())
    return F.when(F.size(named) == 2, named[1].isin(*CHINA_EXCHANGES)).otherwise(bare)


def product_of(symbol: Column, china: bool) -> Column:
    """The letters in front, or all if there are none; outside China also without a month's letter before the year."""
    head = F.split(symbol, r"\.")[0] if china else F.upper(F.split(symbol, r"\.")[0])
    forms = (r"^([A-Za-z]+)",) if china else (r"^([A-Z]{2,4})[FGHJKMNQUVXZ]\d{1,4}$", r"^([A-Z]+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(head, form, 1), F.lit("")) for form in forms), head)


def with_contract(df: DataFrame, china: bool, symbol: str = "symbol", terms: DataFrame | None = None) -> DataFrame:
    """df with multiplier, margin_rate (China) or margin (a contract's), price_limit and fees; unknown products take the defaults. `terms` replaces the tables above; they have some fifty rows, so they are broadcast; other terms aren't by force."""
    names, defaults, text = (("multiplier", "margin_rate", "price_limit", "fee_rate", "fee_lot"), CHINA_DEFAULTS, CHINA_CONTRACTS) if china else (("multiplier", "margin", "price_limit", "fee_lot"), GLOBAL_DEFAULTS, GLOBAL_CONTRACTS)
    if terms is None:
        spark: SparkSession = df.sparkSession
        terms = F.broadcast(spark.createDataFrame(_rows(text, defaults), "product string, " + ", ".join(f"{n} double" for n in names)))
    out = df.withColumn("product", product_of(F.col(symbol), china)).join(terms.withColumn("_known", F.lit(True)), "product", "left")
    unknown = F.col("_known").isNull()
    return out.withColumns({n: F.when(unknown, F.lit(d).cast("double")).otherwise(F.col(n)) for n, d in zip(names, defaults, strict=True)}).drop("_known")


def contract_fee(size: Column, price: Column, multiplier: Column, rate: Column, lot: Column) -> Column:
    return size * price * multiplier * rate + size * lot


def contract_pnl(direction: Column, size: Column, entry: Column, out: Column, multiplier: Column) -> Column:
    return direction * size * (out - entry) * multiplier


def contract_margin(size: Column, price: Column, multiplier: Column, leverage: Column) -> Column:
    return F.try_divide(size * price * multiplier, leverage)


def may_trade(direction: Column, change: Column, limit: Column, held: Column) -> Column:
    """Whether a limit lets a bar trade: direction 1 buys, -1 sells, 0 closes what `held` (its sign) says; without a limit or a change all may."""
    up, down = change >= limit - 0.001, change <= 0.001 - limit
    bars = F.when(direction == 1, up).when(direction == -1, down).when(held > 0, down).when(held < 0, up).otherwise(F.lit(False))
    return ~F.coalesce(bars, F.lit(False))


def board_limit(symbol: Column) -> Column:
    head = F.split(symbol, r"\.")[0]
    out = F.when(head.startswith("8") & (F.length(head) == 6), BEIJING_LIMIT).otherwise(BOARD_LIMIT)
    for start, limit in reversed(BOARD_LIMITS):
        out = F.when(head.startswith(start), limit).otherwise(out)
    return out


def equity_fee(amount: Column, market: Column) -> Column:
    """Hong Kong's fees on both sides, none in the United States."""
    return F.when(market == "hk_equity", amount * HK_FEES[0] + amount * HK_FEES[1] + amount * HK_FEES[2] + amount * HK_FEES[3]).otherwise(0.0)


def lots(size: Column, market: Column) -> Column:
    """Whole lots towards zero: 100 shares in mainland China and Hong Kong, a contract of futures, 1000 units of currency, cents of a share in the United States; 0 at least."""
    whole = lambda n: F.floor(size / n) * n
    out = F.when(market.isin("a_share", "hk_equity"), whole(100)).when(market == "futures", whole(1)).when(market == "forex", whole(1000)).when(market == "us_equity", F.round(size, 2)).otherwise(size)
    return F.greatest(out, F.lit(0.0))


def maintenance_rate(notional: Column) -> Column:
    out = F.lit(BEYOND)
    for most, rate in reversed(TIERS):
        out = F.when(notional <= most, rate).otherwise(out)
    return out


def liquidated(direction: Column, size: Column, entry: Column, mark: Column, leverage: Column) -> Column:
    """Whether margin and open profit no longer exceed the tier's maintenance margin; never without leverage."""
    value = size * mark
    return F.coalesce((leverage > 1) & (size * entry / leverage + direction * size * (mark - entry) <= value * maintenance_rate(value)), F.lit(False))


def _first_of(keys: list, order: tuple) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1


def with_funding(bars: DataFrame, rate: float = 0.0001, symbol: str = "symbol", at: str = "ts", order: tuple = ()) -> DataFrame:
    """bars (direction, size, close) with funding: the charge (longs pay a positive one) at a symbol's first bar of each funding hour, and at a day's first bar outside them."""
    hour = F.when(F.hour(at).isin(*FUNDING_HOURS), F.hour(at)).otherwise(-1)
    first = _first_of([symbol, F.to_date(at), hour], (at, *order))
    return bars.withColumn("funding", F.when(first, F.col("size") * F.col("close") * rate * F.col("direction")).otherwise(0.0))


def pair_of(symbol: Column) -> Column:
    s = F.trim(F.replace(F.replace(F.upper(symbol), F.lit(".FX"), F.lit("")), F.lit("."), F.lit("")))
    return F.when(s.contains("/") | (F.length(s) != 6), s).otherwise(F.concat(F.substring(s, 1, 3), F.lit("/"), F.substring(s, 4, 3)))


def _by_pair(pair: Column, place: int) -> Column:
    out = F.lit(PAIR_DEFAULTS[place])
    for p in PAIRS:
        out = F.when(pair == p[0], p[place + 1]).otherwise(out)
    return out


def with_swap(bars: DataFrame, symbol: str = "symbol", at: str = "ts", order: tuple = ()) -> DataFrame:
    """bars (direction, size) with swap: the credit or debit at a pair's first bar of a day, thrice on Wednesdays."""
    pair = pair_of(F.col(symbol))
    a_lot = F.when(F.col("direction") == 1, _by_pair(pair, 1)).otherwise(_by_pair(pair, 2))
    times = F.when(F.weekday(at) == 2, 3.0).otherwise(1.0)
    return bars.withColumn("swap", F.when(_first_of([symbol, F.to_date(at)], (at, *order)), F.col("size") / LOT * a_lot * times).otherwise(0.0))


def slipped(price: Column, direction: Column, market: Column, symbol: Column) -> Column:
    """The price after slippage: a rate for shares, half the spread and 0.3 pips for pairs."""
    pair = pair_of(symbol)
    pip = F.when(F.substring(pair, 5, 3) == "JPY", 0.01).otherwise(0.0001)
    return (
        F.when(market == "forex", price + direction * (_by_pair(pair, 0) / 2 + EXTRA_PIPS) * pip)
        .when(market == "hk_equity", price * (1 + direction * HK_SLIP)).when(market == "us_equity", price * (1 + direction * US_SLIP)).otherwise(price)
    )
