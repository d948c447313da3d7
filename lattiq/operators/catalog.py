"""One named expression per operator, for queries and tests."""

from __future__ import annotations

from ..functions import expr as X
from ..functions.expr import Expr, col

C, O, H, V = col("close"), col("open"), col("high"), col("volume")
RET = C / X.delay(C, 1) - 1


def operators() -> dict[str, Expr]:
    return {
        "op_rank": X.rank(C), "op_scale": X.scale(C - O), "op_cs_zscore": X.cs_zscore(C), "op_cs_mean": X.cs_mean(C), "op_cs_std": X.cs_std(C), "op_neutralize": X.neutralize(C),
        "op_ts_mean": X.ts_mean(C, 10), "op_ts_std": X.ts_std(C, 10), "op_ts_max": X.ts_max(H, 10), "op_ts_min": X.ts_min(C, 10), "op_ts_sum": X.ts_sum(V, 10), "op_ts_rank": X.ts_rank(C, 10),
        "op_ts_corr": X.ts_corr(C, V, 10), "op_ts_cov": X.ts_cov(C, V, 10), "op_ts_argmax": X.ts_argmax(C, 10), "op_ts_argmin": X.ts_argmin(C, 10), "op_delta": X.delta(C, 5), "op_delay": X.delay(C, 3),
        "op_decay_linear": X.decay_linear(C, 10), "op_signed_power": X.signed_power(C - O, 0.5), "op_safe_div": X.safe_div(C, V), "op_ts_product": X.ts_product(1 + RET / 10, 5), "op_ts_skew": X.ts_skew(C, 20),
        "op_ts_quantile": X.ts_quantile(C, 10, 0.8), "op_ts_slope": X.ts_slope(C, 20), "op_where": X.where(C > O, 1, -1), "op_last_known": X.last_known(RET, 5),
        "op_cum_max": X.cum_max(C), "op_cum_sum": X.cum_sum(V), "op_forward_return": X.lead(C, 5) / X.lead(C, 1) - 1, "op_ts_zscore": (C - X.ts_mean(C, 20)) / X.ts_std(C, 20), "op_ts_pct": C / X.delay(C, 10) - 1,
    }
