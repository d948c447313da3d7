"""Factor expressions: a small tree of element-wise, per-series and per-date operators, compiled to staged Spark windows.

All expressions of a batch share their sub-trees, and window operators are emitted in alternating stages (all per-series ones that are ready, then all per-date ones), so the number of shuffles is the
depth of alternation and not the number of expressions. `to_sql` states the same tree as a chain of SQL views for checking in another engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12
#: Added before digests are rounded: unit prices often end in an exact half of the last digit, which engines round differently.
NUDGE = 1.7e-8
#: Numbers beyond this are shown by their decimal logarithm; their last digits are rounding noise.
HUGE = 1e9
#: From here on three digits fewer are shown, so that no more than about twelve places of a double are compared.
LARGE = 1e3


def digest(name: str, digits: int = 6) -> Column:
    """A computed number as queries show it."""
    x = F.col(name)
    shown = F.when(F.abs(x) < LARGE, F.round(x + NUDGE, digits)).when(F.abs(x) < HUGE, F.round(x + NUDGE, max(digits - 3, 0)))
    return shown.otherwise(F.signum(x) * F.round(F.log10(F.abs(x)), digits)).alias(name)


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()
    param: tuple = ()

    def __hash__(self):
        h = self.__dict__.get("_h")
        if h is None:
            h = hash((self.op, self.args, self.param))
            object.__setattr__(self, "_h", h)
        return h

    def __add__(self, o): return Expr("+", (self, lift(o)))
    def __radd__(self, o): return Expr("+", (lift(o), self))
    def __sub__(self, o): return Expr("-", (self, lift(o)))
    def __rsub__(self, o): return Expr("-", (lift(o), self))
    def __mul__(self, o): return Expr("*", (self, lift(o)))
    def __rmul__(self, o): return Expr("*", (lift(o), self))
    def __truediv__(self, o): return Expr("/", (self, lift(o)))
    def __rtruediv__(self, o): return Expr("/", (lift(o), self))
    def __neg__(self): return Expr("*", (lift(-1), self))
    def __lt__(self, o): return Expr("<", (self, lift(o)))
    def __le__(self, o): return Expr("<=", (self, lift(o)))
    def __gt__(self, o): return Expr(">", (self, lift(o)))
    def __ge__(self, o): return Expr(">=", (self, lift(o)))
    def __and__(self, o): return Expr("and", (self, lift(o)))
    def __or__(self, o): return Expr("or", (self, lift(o)))


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Expr("const", (), (float(x),))


def _n(d) -> int:
    d = int(d)  # windows of published formulas may be fractional; they are floored
    if d < 1:
        raise ValueError(f"a window or lag must be 1 or more (no look-ahead), got {d}")
    return d


col = lambda name: Expr("col", (), (name,))
where = lambda c, a, b: Expr("where", (c, lift(a), lift(b)))
eq = lambda a, b: Expr("=", (lift(a), lift(b)))
absolute = lambda x: Expr("abs", (x,))
log = lambda x: Expr("log", (x,))
exponential = lambda x: Expr("exp", (x,))
sign = lambda x: Expr("sign", (x,))
power = lambda x, p: Expr("power", (x, lift(p)))
signed_power = lambda x, p: Expr("signed_power", (x, lift(p)))
maximum = lambda a, b: Expr("maximum", (lift(a), lift(b)))
minimum = lambda a, b: Expr("minimum", (lift(a), lift(b)))
fill = lambda x, v: Expr("fill", (x, lift(v)))
safe_div = lambda a, b: Expr("safe_div", (lift(a), lift(b)))
# per series, over time
delay = lambda x, d: Expr("delay", (x,), (_n(d),))
delta = lambda x, d: x - delay(x, d)
ts_sum = lambda x, n: Expr("ts_sum", (x,), (_n(n),))
ts_mean = lambda x, n: Expr("ts_mean", (x,), (_n(n),))
ts_std = lambda x, n: Expr("ts_std", (x,), (_n(n),))
ts_max = lambda x, n: Expr("ts_max", (x,), (_n(n),))
ts_min = lambda x, n: Expr("ts_min", (x,), (_n(n),))
ts_rank = lambda x, n: Expr("ts_rank", (x,), (_n(n),))
ts_argmax = lambda x, n: Expr("ts_argmax", (x,), (_n(n),))
ts_argmin = lambda x, n: Expr("ts_argmin", (x,), (_n(n),))
ts_product = lambda x, n: Expr("ts_product", (x,), (_n(n),))
ts_skew = lambda x, n: Expr("ts_skew", (x,), (_n(n),))
ts_slope = lambda x, n: Expr("ts_slope", (x,), (_n(n),))
ts_quantile = lambda x, n, q: Expr("ts_quantile", (x,), (_n(n), float(q)))
decay_linear = lambda x, n: Expr("decay_linear", (x,), (_n(n),))
ts_corr = lambda x, y, n: Expr("ts_corr", (x, y), (_n(n),))
ts_cov = lambda x, y, n: Expr("ts_cov", (x, y), (_n(n),))
row_index = Expr("row_index")
#: Exponential average with weight m/n on the new value; started by the first value. Sequential, so it runs as a grouped map.
sma = lambda x, n, m: Expr("sma", (x,), (float(n), float(m)))
cum_sum = lambda x: Expr("cum_sum", (x,))
cum_max = lambda x: Expr("cum_max", (x,))
last_known = lambda x, n: Expr("last_known", (x,), (_n(n),))
#: Labels only: values of later rows.
lead = lambda x, d: Expr("lead", (x,), (_n(d),))
# per date, over codes
rank = lambda x: Expr("rank", (x,))
scale = lambda x, a=1.0: Expr("scale", (x,), (float(a),))
cs_zscore = lambda x: Expr("cs_zscore", (x,))
cs_mean = lambda x: Expr("cs_mean", (x,))
cs_std = lambda x: Expr("cs_std", (x,))
cs_count = lambda x: Expr("cs_count", (x,))
neutralize = lambda x: Expr("neutralize", (x,))

TS = {"delay", "ts_sum", "ts_mean", "ts_std", "ts_max", "ts_min", "ts_rank", "ts_argmax", "ts_argmin", "ts_product", "ts_skew", "ts_slope", "ts_quantile", "decay_linear", "ts_corr", "ts_cov", "row_index", "cum_sum", "cum_max", "last_known", "lead"}
CS = {"rank", "scale", "cs_zscore", "cs_mean", "cs_std", "cs_count", "neutralize"}
SEQ = {"sma"}
_KIND = dict.fromkeys(TS, "ts") | dict.fromkeys(CS, "cs") | dict.fromkeys(SEQ, "seq")
#: Operators that compare values; computed arguments are compared to 1e-9, so that rounding noise makes no order.
_ORDERED = {"rank", "ts_rank", "ts_argmax", "ts_argmin"}
#: Smoothing of a window std to exactly 0 where only rounding noise is left.
_FLAT = 1e-13


def _elementwise(e: Expr, a: list[Column]) -> Column:
    op = e.op
    if op == "const":
        return F.lit(e.param[0])
    if op in ("+", "-", "*"):
        return {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op](*a)
    if op == "/":
        return F.try_divide(*a)
    if op in ("<", "<=", ">", ">=", "="):
        # a comparison with a missing value is false, as in array code
        return F.coalesce({"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y}[op](*a), F.lit(False))
    if op == "and":
        return a[0] & a[1]
    if op == "or":
        return a[0] | a[1]
    if op == "where":
        return F.when(a[0], a[1]).otherwise(a[2])
    if op == "abs":
        return F.abs(a[0])
    if op == "log":
        return F.when(a[0] > 0, F.log(a[0]))
    if op == "exp":
        return F.exp(a[0])
    if op == "sign":
        return F.signum(a[0])
    if op == "power":
        return F.when((a[0] >= 0) | (a[1] == F.floor(a[1])), F.when((a[0] != 0) | (a[1] >= 0), F.pow(a[0], a[1])))
    if op == "signed_power":
        return F.signum(a[0]) * F.pow(F.abs(a[0]), a[1])
    if op == "maximum":
        return F.when(a[0].isNotNull() & a[1].isNotNull(), F.greatest(*a))
    if op == "minimum":
        return F.when(a[0].isNotNull() & a[1].isNotNull(), F.least(*a))
    if op == "fill":
        return F.coalesce(*a)
    if op == "safe_div":
        return F.try_divide(a[0], a[1] + EPS * F.signum(a[1]))
    raise ValueError(op)


def _window(e: Expr, a: list[Column], code: str, date: str) -> Column:
    """A window operator; a per-series one gives NULL unless the whole window has values."""
    op, x = e.op, a[0] if a else None
    ordered = W.partitionBy(code).orderBy(date)
    if op in CS:
        at = W.partitionBy(date)
        mean, std = F.avg(x).over(at), F.stddev_samp(x).over(at)
        if op == "scale":
            return F.try_divide(F.lit(e.param[0]) * x, F.nullif(F.sum(F.abs(x)).over(at), F.lit(0.0)))
        if op == "cs_zscore":
            return F.try_divide(x - mean, F.when(std > _FLAT, std))
        if op == "cs_mean":
            return mean
        if op == "cs_std":
            return std
        if op == "cs_count":
            return F.count(x).over(at).cast("double")
        return x - F.avg(x).over(W.partitionBy(date, "sector"))
    if op == "delay":
        return F.lag(x, e.param[0]).over(ordered)
    if op == "lead":
        return F.lead(x, e.param[0]).over(ordered)
    if op == "row_index":
        return F.row_number().over(ordered).cast("double")
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    if op == "cum_sum":
        return F.sum(x).over(running)
    if op == "cum_max":
        return F.max(x).over(running)
    n = e.param[0]
    if op == "last_known":
        return F.last(x, ignorenulls=True).over(ordered.rowsBetween(-n, 0))
    w = ordered.rowsBetween(-(n - 1), 0)
    both = x if len(a) == 1 else F.when(x.isNotNull() & a[1].isNotNull(), x)
    full = F.count(both).over(w) == n
    simple = {"ts_sum": F.sum, "ts_mean": F.avg, "ts_max": F.max, "ts_min": F.min, "ts_std": F.stddev_samp, "ts_product": F.product}
    if op in simple:
        return F.when(full, simple[op](x).over(w))
    if op in ("ts_corr", "ts_cov"):
        y = a[1]
        cov = F.covar_samp(x, y).over(w)
        if op == "ts_cov":
            return F.when(full, cov)
        sx, sy = F.stddev_samp(x).over(w), F.stddev_samp(y).over(w)
        return F.when(full & (sx > _FLAT) & (sy > _FLAT), F.try_divide(cov, sx * sy))
    if op == "ts_skew":
        m, s = F.avg(x).over(w), F.stddev_pop(x).over(w)
        third = F.aggregate(F.collect_list(x).over(w), F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m) * (v - m)) / n
        return F.when(full & (s > _FLAT), third / (s * s * s) * ((n * (n - 1)) ** 0.5 / (n - 2)))
    if op == "ts_quantile":
        return F.when(full, F.percentile(x, e.param[1]).over(w))
    values = F.collect_list(x).over(w)
    if op == "ts_rank":
        less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
        return F.when(full, (less + F.lit(0.5) * (same + 1)) / n)
    if op == "ts_argmax":
        return F.when(full, F.array_position(values, F.max(x).over(w)) - 1).cast("double")
    if op == "ts_argmin":
        return F.when(full, F.array_position(values, F.min(x).over(w)) - 1).cast("double")
    if op == "decay_linear":
        # the oldest value has the largest weight
        terms = F.zip_with(values, F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda v, k: v * k)
        return F.when(full, F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0))) / (n * (n + 1) / 2))
    if op == "ts_slope":
        terms = F.zip_with(values, F.sequence(F.lit(0), F.lit(n - 1)), lambda v, k: v * (k - (n - 1) / 2))
        return F.when(full, F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0))) / (n * (n * n - 1) / 12))
    raise ValueError(op)


def _rank(x: Column, date: str) -> Column:
    """Percentile rank among the date's values; ties get their mean rank, missing values stay missing and don't count."""
    at = W.partitionBy(date)
    low, ties = F.rank().over(at.orderBy(x.asc_nulls_last())), F.count(F.lit(1)).over(W.partitionBy(date, x))
    return F.when(x.isNotNull(), (low + (ties - 1) / 2) / F.count(x).over(at))


class Compiler:
    """Compiles named expressions over a panel; code and date name the series and time columns."""

    def __init__(self, exprs: dict[str, Expr], code: str = "code", date: str = "date"):
        self.exprs, self.code, self.date = exprs, code, date
        self.names: dict[Expr, str] = {}
        self.order: list[Expr] = []
        seen: set[Expr] = set()

        def walk(e: Expr):
            if e in seen:
                return
            seen.add(e)
            for a in e.args:
                walk(a)
            self.order.append(e)

        for e in exprs.values():
            walk(lift(e))
        self.windows = [e for e in self.order if e.op in _KIND]
        for i, e in enumerate(self.windows):
            self.names[e] = f"_e{i}"

    def needs(self, e: Expr) -> set[Expr]:
        """Window operators that e uses directly."""
        out, todo = set(), list(e.args)
        while todo:
            a = todo.pop()
            if a.op in _KIND:
                out.add(a)
            else:
                todo += a.args
        return out

    def stages(self) -> list[tuple[str, list[Expr]]]:
        """Batches of window operators of one kind, each using earlier ones only; kinds alternate as seldom as a greedy choice allows."""
        needs = {e: self.needs(e) for e in self.windows}
        done: set[Expr] = set()
        out: list[tuple[str, list[Expr]]] = []
        kind = "ts"
        while len(done) < len(self.windows):
            ready = [e for e in self.windows if e not in done and needs[e] <= done]
            own = [e for e in ready if _KIND[e.op] == kind]
            if not own:
                kind = _KIND[ready[0].op]
                continue
            out.append((kind, own))
            done |= set(own)
        return out

    def column(self, e: Expr) -> Column:
        if e in self.names:
            return F.col(self.names[e])
        if e.op == "col":
            return F.col(e.param[0])
        return _elementwise(e, [self.column(a) for a in e.args])

    def apply(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(date, code, *keep, one column per expression)."""
        for kind, batch in self.stages():
            if kind == "seq":
                df = self._sequential(df, batch)
                continue
            # arguments are made columns first, so each is computed once for the several aggregates of an operator
            made = {f"{self.names[e]}_{k}": self.column(a) for e in batch for k, a in enumerate(e.args) if a.op not in _KIND and a.op != "col"}
            df = df.withColumns(made) if made else df
            new = {}
            for e in batch:
                a = [F.col(f"{self.names[e]}_{k}") if f"{self.names[e]}_{k}" in made else self.column(x) for k, x in enumerate(e.args)]
                if e.op in _ORDERED:
                    a = [c if x.op == "col" else F.rint(c * 1e9) / 1e9 for c, x in zip(a, e.args, strict=True)]
                new[self.names[e]] = _rank(a[0], self.date) if e.op == "rank" else _window(e, a, self.code, self.date)
            df = df.withColumns(new).drop(*made)
        return df.select(self.date, self.code, *keep, *(self.column(lift(e)).alias(n) for n, e in self.exprs.items()))

    def _sequential(self, df: DataFrame, batch: list[Expr]) -> DataFrame:
        """Exponential averages: a recursion along each series, run as a grouped map (a series at a time)."""
        import pandas as pd

        names = [self.names[e] for e in batch]
        made = {f"{n}_x": self.column(e.args[0]) for n, e in zip(names, batch, strict=True)}
        df = df.withColumns(made)
        date, specs = self.date, [(n, e.param[1] / e.param[0]) for n, e in zip(names, batch, strict=True)]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(date, kind="stable")
            for n, alpha in specs:
                pdf[n] = pdf[f"{n}_x"].ewm(alpha=alpha, adjust=False).mean()
            return pdf.drop(columns=[f"{n}_x" for n, _ in specs])

        left = df.drop(*made)
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema] + [f"`{n}` double" for n in names])
        return df.groupBy(self.code).applyInPandas(run, schema)

    # ------------------------------------------------------------------ SQL

    def sql_of(self, e: Expr) -> str:
        if e in self.names:
            return self.names[e]
        a = [self.sql_of(x) for x in e.args]
        op = e.op
        if op == "col":
            return e.param[0]
        if op == "const":
            return f"CAST({e.param[0]!r} AS DOUBLE)"
        if op in ("+", "-", "*"):
            return f"({a[0]} {op} {a[1]})"
        if op == "/":
            return f"({a[0]} / nullif({a[1]}, 0))"
        if op in ("<", "<=", ">", ">=", "="):
            return f"coalesce({a[0]} {op} {a[1]}, false)"
        if op in ("and", "or"):
            return f"({a[0]} {op} {a[1]})"
        forms = {
            "where": "CASE WHEN {0} THEN {1} ELSE {2} END", "abs": "abs({0})", "log": "CASE WHEN {0} > 0 THEN ln({0}) END", "exp": "exp({0})", "sign": "CAST(sign({0}) AS DOUBLE)",
            "power": "CASE WHEN {0} >= 0 OR {1} = floor({1}) THEN CASE WHEN {0} != 0 OR {1} >= 0 THEN pow({0}, {1}) END END", "signed_power": "(sign({0}) * pow(abs({0}), {1}))",
            "maximum": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END", "minimum": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END",
            "fill": "coalesce({0}, {1})", "safe_div": "({0} / nullif({1} + 1e-12 * sign({1}), 0))",
        }
        return forms[op].format(*a)

    def _sql_window(self, e: Expr, a: list[str]) -> str:
        op, x = e.op, a[0] if a else ""
        series, date = f"PARTITION BY {self.code} ORDER BY {self.date}", f"PARTITION BY {self.date}"
        if op == "rank":
            return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({date} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {self.date}, {x}) - 1) / 2.0) / count({x}) OVER ({date}) END"
        forms = {
            "scale": f"{e.param[0] if e.param else 1} * {x} / nullif(sum(abs({x})) OVER ({date}), 0)",
            "cs_zscore": f"({x} - avg({x}) OVER ({date})) / CASE WHEN stddev_samp({x}) OVER ({date}) > {_FLAT} THEN stddev_samp({x}) OVER ({date}) END",
            "cs_mean": f"avg({x}) OVER ({date})", "cs_std": f"stddev_samp({x}) OVER ({date})", "cs_count": f"CAST(count({x}) OVER ({date}) AS DOUBLE)", "neutralize": f"{x} - avg({x}) OVER (PARTITION BY {self.date}, sector)",
            "row_index": f"CAST(row_number() OVER ({series}) AS DOUBLE)", "cum_sum": f"sum({x}) OVER ({series} ROWS UNBOUNDED PRECEDING)", "cum_max": f"max({x}) OVER ({series} ROWS UNBOUNDED PRECEDING)",
        }
        if op in forms:
            return forms[op]
        n = e.param[0]
        if op in ("delay", "lead"):
            return f"{'lag' if op == 'delay' else 'lead'}({x}, {n}) OVER ({series})"
        if op == "last_known":
            return f"last_value({x} IGNORE NULLS) OVER ({series} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
        w = f"OVER ({series} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        counted = x if len(a) == 1 else f"CASE WHEN {a[1]} IS NOT NULL THEN {x} END"
        full = f"count({counted}) {w} = {n}"
        values = f"list({x}) {w}"
        y = a[1] if len(a) > 1 else ""
        forms = {
            "ts_sum": f"sum({x}) {w}", "ts_mean": f"avg({x}) {w}", "ts_std": f"stddev_samp({x}) {w}", "ts_max": f"max({x}) {w}", "ts_min": f"min({x}) {w}", "ts_product": f"product({x}) {w}",
            "ts_cov": f"covar_samp({x}, {y}) {w}", "ts_corr": f"CASE WHEN stddev_samp({x}) {w} > {_FLAT} AND stddev_samp({y}) {w} > {_FLAT} THEN covar_samp({x}, {y}) {w} / (stddev_samp({x}) {w} * stddev_samp({y}) {w}) END" if y else "",
            "ts_skew": f"CASE WHEN stddev_pop({x}) {w} > {_FLAT} THEN skewness({x}) {w} END",
            "ts_quantile": f"quantile_cont({x}, {e.param[-1]}) {w}",
            "ts_rank": f"(len(list_filter({values}, lambda v: v < {x})) + 0.5 * (len(list_filter({values}, lambda v: v = {x})) + 1)) / {n}",
            "ts_argmax": f"CAST(list_position({values}, max({x}) {w}) - 1 AS DOUBLE)", "ts_argmin": f"CAST(list_position({values}, min({x}) {w}) - 1 AS DOUBLE)",
            "decay_linear": f"list_dot_product(list_transform({values}, lambda v: coalesce(v, 0.0)), [{', '.join(str(float(n - k)) for k in range(n))}]) / {n * (n + 1) / 2}",
            "ts_slope": f"list_dot_product(list_transform({values}, lambda v: coalesce(v, 0.0)), [{', '.join(str(k - (n - 1) / 2) for k in range(n))}]) / {n * (n * n - 1) / 12}",
        }
        return f"CASE WHEN {full} THEN {forms[op]} END"

    def to_sql(self, panel_sql: str, keep: tuple[str, ...] = (), digits: int | None = 6) -> str | None:
        """The same plan as one SQL statement; None if it has a sequential operator."""
        views, last = [panel_sql], "panel"
        for i, (kind, batch) in enumerate(self.stages()):
            if kind == "seq":
                return None
            made = {(e, k): self.sql_of(a) for e in batch for k, a in enumerate(e.args) if a.op not in _KIND and a.op != "col"}
            if made:
                views.append(f"a{i} AS (SELECT *, {', '.join(f'{s} AS {self.names[e]}_{k}' for (e, k), s in made.items())} FROM {last})")
                last = f"a{i}"
            cols = []
            for e in batch:
                a = [f"{self.names[e]}_{k}" if (e, k) in made else self.sql_of(x) for k, x in enumerate(e.args)]
                if e.op in _ORDERED:
                    a = [s if x.op == "col" else f"(round_even({s} * 1e9, 0) / 1e9)" for s, x in zip(a, e.args, strict=True)]
                cols.append(f"{self._sql_window(e, a)} AS {self.names[e]}")
            views.append(f"s{i} AS (SELECT *, {', '.join(cols)} FROM {last})")
            last = f"s{i}"
        shown = lambda s: s if digits is None else f"CASE WHEN abs({s}) < {LARGE} THEN round({s} + {NUDGE}, {digits}) WHEN abs({s}) < {HUGE} THEN round({s} + {NUDGE}, {max(digits - 3, 0)}) ELSE sign({s}) * round(log10(abs({s})), {digits}) END"
        return "WITH " + ",\n".join(views) + f"\nSELECT {', '.join([self.date, self.code, *keep, *(f'{shown(self.sql_of(lift(e)))} AS {n}' for n, e in self.exprs.items())])} FROM {last}"


def evaluate(df: DataFrame, exprs: dict[str, Expr], code: str = "code", date: str = "date", keep: tuple[str, ...] = ()) -> DataFrame:
    return Compiler(exprs, code, date).apply(df, keep)
