"""Trade-journal analytics: clean-up of raw rows, profile, and four behaviour diagnostics over trades and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens that brokers use for the side of a trade (fixed values), in lower case.
BUY = ["buy", "b", "买入", "买", "long", "证券买入"]
SELL = ["sell", "s", "卖出", "卖", "short", "证券卖出"]
#: (diagnostic, from here medium, from here high)
SEVERITIES = {"disposition": (1.2, 1.5), "overtrading": (0.3, 1.0), "chasing": (0.4, 0.6), "anchoring": (0.33, 0.66)}


def side(raw: Column) -> Column:
    token = F.lower(F.trim(raw))
    return F.when(token.isin(BUY), "buy").when(token.isin(SELL), "sell")


def number(raw: Column) -> Column:
    """Numbers as brokers print them: thousands separators, currency signs and blanks don't count; what isn't a number is NULL."""
    return F.regexp_replace(raw.cast("string"), r"[,\s$¥€£]", "").try_cast("double")


def market(symbol: Column) -> Column:
    """Market of a symbol by its form, first match wins."""
    s = F.upper(symbol.cast("string"))
    return (
        F.when(s.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), "china_a").when(s.rlike(r"^\d{4,5}\.HK$"), "hk_equity").when(s.rlike(r"^[A-Z]+[-/]?(USDT|USDC|BTC)$"), "crypto")
        .when(s.rlike(r"^[A-Z]{3}/?[A-Z]{3}$"), "forex").when(s.rlike(r"^[A-Z]{1,5}(\.US)?$"), "us_equity").otherwise("other")
    )


#: Exports of brokers (fixed values): columns that tell a dialect, and where it has each field; several columns of a fee are added.
DIALECTS = {
    "tonghuashun": ((("成交时间", "证券代码", "操作"),), {"at": ("成交时间",), "symbol": "证券代码", "name": "证券名称", "side": ("操作",), "quantity": "成交数量", "price": "成交价格", "amount": "成交金额", "fee": ("手续费", "印花税", "过户费")}),
    "eastmoney": ((("买卖标志", "股票代码"), ("买卖标志", "成交均价")), {"at": ("成交日期", "成交时间"), "symbol": "股票代码", "name": "股票名称", "side": ("买卖标志",), "quantity": "成交数量", "price": "成交均价", "amount": "成交金额", "fee": ("佣金", "印花税")}),
    "futu": ((("Date", "Symbol", "Side"), ("Date", "Symbol", "Direction")), {"at": ("Date", "Time"), "symbol": "Symbol", "name": "Name", "side": ("Side", "Direction"), "quantity": "Quantity", "price": "Price", "amount": "Amount", "fee": ("Commission", "Platform Fee")}),
}
#: Names of fields in other exports, whatever their case; the first that is there counts (fixed values).
ALIASES = {
    "at": ("datetime", "time", "date"), "symbol": ("symbol", "ticker", "code"), "name": ("name", "instrument"), "side": ("side", "direction", "action"), "quantity": ("quantity", "qty", "size", "volume"),
    "price": ("price",), "amount": ("amount", "value", "notional"), "fee": ("fee", "commission", "fees"),
}
#: Exchange of a mainland code by its first digit (fixed values).
EXCHANGES = {"6": ".SH", "0": ".SZ", "3": ".SZ", "4": ".BJ", "8": ".BJ"}


def dialect(columns: list[str]) -> str:
    """Whose export has these columns; generic where names of a time and of a symbol are found, else unknown."""
    for name, (signs, _) in DIALECTS.items():
        if any(set(sign) <= set(columns) for sign in signs):
            return name
    lower = {c.lower() for c in columns}
    return "generic" if lower & set(ALIASES["at"]) and lower & set(ALIASES["symbol"]) else "unknown"


def qualified(symbol: Column) -> Column:
    """Mainland codes with six digits and their exchange; those with a point stay, in capitals."""
    s = F.trim(symbol.cast("string"))
    s = F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)
    ending = F.lit("")
    for digit, exchange in EXCHANGES.items():
        ending = F.when(F.substring(s, 1, 1) == digit, exchange).otherwise(ending)
    return F.when(s.contains("."), F.upper(s)).otherwise(F.concat(s, ending))


def canonical(raw: DataFrame) -> DataFrame:
    """datetime, symbol, name, side, quantity, price, amount, fee, market of an export of any dialect. Numbers that can't be read count as 0, an amount of 0 is quantity times price, a side without a selling word is a purchase."""
    kind, have = dialect(raw.columns), raw.columns
    if kind in DIALECTS:
        fields = DIALECTS[kind][1]
    else:
        lower = {c.strip().lower(): c for c in reversed(have)}
        found = {f: next((lower[a] for a in names if a in lower), "") for f, names in ALIASES.items()}
        fields = found | {"at": (found["at"],), "side": (found["side"],), "fee": (found["fee"],)}
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c in have else F.lit("")
    amount_of = lambda c: F.coalesce(F.regexp_replace(text(c), ",", "").try_cast("double"), F.lit(0.0))
    parts = [text(c) for c in fields["at"]]
    if kind == "eastmoney":
        parts[0] = F.regexp_replace(parts[0], r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    quantity, price = amount_of(fields["quantity"]), amount_of(fields["price"])
    token = F.lower(text(next((c for c in fields["side"] if c in have), "")))
    sells = token.isin(SELL)
    for word in SELL:
        sells = sells | token.contains(word)
    mainland = kind in ("tonghuashun", "eastmoney")
    symbol = qualified(text(fields["symbol"])) if mainland else F.upper(text(fields["symbol"])) if kind == "futu" else text(fields["symbol"])
    hint = F.lower(text("Market"))
    where = F.lit("china_a") if mainland else market(symbol)
    if kind == "futu":
        where = F.when(hint == "cn", "china_a").when(hint.isin("hk", "us"), hint).when(symbol.endswith(".HK"), "hk").when(~symbol.contains("."), "us").otherwise("other")
    fee = F.lit(0.0)
    for c in fields["fee"]:
        fee = fee + amount_of(c)
    return raw.select(
        F.trim(F.concat_ws(" ", *parts)).alias("datetime"), symbol.alias("symbol"), text(fields["name"]).alias("name"), F.when(sells, "sell").otherwise("buy").alias("side"), quantity.alias("quantity"), price.alias("price"),
        F.coalesce(F.nullif(amount_of(fields["amount"]), F.lit(0.0)), quantity * price).alias("amount"), fee.alias("fee"), where.alias("market"),
    )


def select_rows(trades: DataFrame, expression: str, at: str = "datetime") -> DataFrame:
    """The small filter language of journals: "<date> to <date>" (both days whole) or "<column>=<value>" (case doesn't matter); empty keeps all."""
    text = expression.strip()
    if not text:
        return trades
    if " to " in text:
        low, high = (x.strip() for x in text.split(" to ", 1))
        return trades.where((F.col(at) >= F.lit(low).cast("timestamp")) & (F.col(at) < F.date_add(F.lit(high).cast("date"), 1).cast("timestamp")))
    name, _, value = (x.strip() for x in text.partition("="))
    if name not in trades.columns:
        raise ValueError(f"no column {name!r}; have {', '.join(trades.columns)}")
    return trades.where(F.upper(F.col(name).cast("string")) == value.upper())


def severity(score: Column, kind: str) -> Column:
    medium, high = SEVERITIES[kind]
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def hold_days(trips: DataFrame) -> DataFrame:
    return trips.withColumn("hold_days", (F.unix_micros(F.col("sell_at").cast("timestamp")) - F.unix_micros(F.col("buy_at").cast("timestamp"))) / 86_400_000_000)


def disposition(trips: DataFrame) -> DataFrame:
    """One row: mean days that losers and winners were held, their ratio, severity."""
    t = hold_days(trips).agg(F.avg(F.when(F.col("pnl") > 0, F.col("hold_days"))).alias("winner_days"), F.avg(F.when(F.col("pnl") < 0, F.col("hold_days"))).alias("loser_days"))
    t = t.withColumn("score", F.try_divide("loser_days", "winner_days"))
    return t.withColumn("severity", severity(F.col("score"), "disposition"))


def overtrading(trades: DataFrame, trips: DataFrame, at: str = "datetime") -> DataFrame:
    """One row: mean profit of round trips sold on busy days (upper quartile of trades a day) and quiet days (lower quartile), how much worse busy days are, severity.

    Days are counted first; the quartiles come from the daily counts (a row per day), and round trips meet their day's class by an equality join.
    """
    daily = trades.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    cuts = daily.agg(F.percentile("n", 0.75).alias("busy"), F.percentile("n", 0.25).alias("quiet"), F.count(F.lit(1)).alias("days"))
    daily = daily.join(F.broadcast(cuts))  # one row
    t = trips.withColumn("day", F.to_date("sell_at")).join(daily, "day")
    s = t.agg(F.avg(F.when(F.col("n") >= F.col("busy"), F.col("pnl"))).alias("busy_pnl"), F.avg(F.when(F.col("n") <= F.col("quiet"), F.col("pnl"))).alias("quiet_pnl"))
    gap = F.col("quiet_pnl") - F.col("busy_pnl")
    s = s.withColumn("score", F.when(gap > 0, gap / F.when(F.col("quiet_pnl") != 0, F.abs("quiet_pnl")).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)))
    return s.withColumn("severity", severity(F.col("score"), "overtrading"))


def chasing(trades: DataFrame, at: str = "datetime", tie: str = "trade_id") -> DataFrame:
    """One row: share of buys at over 3 % more than the symbol's third buy before, number of buys that have one, severity."""
    b = trades.where("side = 'buy'").withColumn("_before", F.lag("price", 3).over(W.partitionBy("symbol").orderBy(at, tie))).where("_before IS NOT NULL")
    s = b.agg(F.avg((F.col("price") > F.col("_before") * 1.03).cast("double")).alias("score"), F.count(F.lit(1)).alias("n_buys"))
    return s.withColumn("severity", severity(F.col("score"), "chasing"))


def anchoring(trades: DataFrame, least: int = 5, band: float = 0.05) -> DataFrame:
    """One row: share of symbols of at least five trades whose prices vary by under 5 % of their mean, number of symbols, severity."""
    g = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd")).where((F.col("n") >= least) & (F.col("mean") != 0))
    s = g.agg(F.avg((F.col("sd") / F.col("mean") < band).cast("double")).alias("score"), F.count(F.lit(1)).alias("n_symbols"))
    return s.withColumn("severity", severity(F.col("score"), "anchoring"))


def profile(trades: DataFrame, trips: DataFrame, at: str = "datetime") -> DataFrame:
    """One row: trades, trades a week, round trips, mean holding days, win rate, win over loss, total profit, greatest fall of the running profit."""
    t = trades.agg(F.count(F.lit(1)).alias("n_trades"), (F.datediff(F.max(at), F.min(at)) / 7.0).alias("_weeks"))
    # the running profit: per day first, so the ordered pass has a row per day
    day = trips.groupBy(F.to_date("sell_at").alias("day")).agg(F.sum("pnl").alias("p"))
    run = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    fall = day.withColumn("c", F.sum("p").over(run)).withColumn("fall", F.col("c") - F.greatest(F.max("c").over(run), F.lit(0.0))).agg(F.min("fall").alias("max_fall"))
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    r = hold_days(trips).agg(
        F.count(F.lit(1)).alias("n_round_trips"), F.avg("hold_days").alias("mean_hold_days"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(win), F.avg(loss)).alias("win_loss_ratio"), F.sum("pnl").alias("total_pnl"),
    )
    one = r.join(F.broadcast(t)).join(F.broadcast(fall))  # single rows
    return one.select("n_trades", F.try_divide("n_trades", F.greatest("_weeks", F.lit(1.0))).alias("trades_per_week"), *r.columns, "max_fall")
