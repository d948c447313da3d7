"""Distribution of holders' costs by price, bar by bar: turnover thins it out, a bar's volume adds a triangle between low and high. Every bar depends on the one before, so a series is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FIELDS = ("profit_share", "cost_gap", "width_70", "width_90", "spread", "skew")
#: Bins of price, bars without a result at the start, turnover in percent before one is known (fixed values).
BINS, WARMUP, FIRST_TURNOVER = 100, 20, 5.0


def _price_at(filled: np.ndarray, centers: np.ndarray, share: float) -> float:
    """The price below which that share of the costs lies, by straight lines between bins."""
    i = int(np.searchsorted(filled, share))
    if i <= 0:
        return centers[0]
    if i >= len(centers):
        return centers[-1]
    step = filled[i] - filled[i - 1]
    return centers[i] if step < 1e-12 else centers[i - 1] + (share - filled[i - 1]) / step * (centers[i] - centers[i - 1])


def chip_structure(panel: DataFrame, turnover: str = "turnover", code: str = "code", date: str = "date") -> DataFrame:
    """code, date and, from the 21st bar on: share of holders in profit, distance of the close from the mean cost, widths of the middle 70 and 90 % of costs over the range of prices, deviation over mean, skewness. Bins lie between the first
    percentile of lows and the last of highs over the whole series, as the definition has it, so a bar's values depend on later ones. A bar without turnover thins by the last one known and adds nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable")
        o, h, low, c, v, t = (pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume", "_t"))
        out = np.full((len(c), len(FIELDS)), np.nan)
        seen = np.isfinite(low).any() and np.isfinite(h).any()
        bottom, top = (np.nanpercentile(low, 1), np.nanpercentile(h, 99)) if seen else (0.0, 0.0)
        if top > bottom:
            edges = np.linspace(bottom, top, BINS + 1)
            at = (edges[:-1] + edges[1:]) / 2
            held, known = np.zeros(BINS), FIRST_TURNOVER
            for i in range(len(c)):
                traded = np.isfinite(t[i]) and t[i] > 0
                known = t[i] if traded else known
                held *= max(0.0, 1 - min(known, 100.0) / 100)
                if traded and h[i] > low[i]:
                    shape = np.where((at >= low[i]) & (at <= h[i]), np.maximum(0.0, 1 - np.abs(at - (o[i] + c[i]) / 2) / (h[i] - low[i])), 0.0)
                    if shape.sum() > 0:
                        held += v[i] * shape / shape.sum()
                total = held.sum()
                if i < WARMUP or total <= 1e-12:
                    continue
                p = held / total
                mean = at @ p
                var = (at - mean) ** 2 @ p
                filled = np.cumsum(p)
                q05, q15, q85, q95 = (_price_at(filled, at, q) for q in (0.05, 0.15, 0.85, 0.95))
                out[i] = (p[at <= c[i]].sum(), (c[i] - mean) / (mean + 1e-12), (q85 - q15) / (top - bottom), (q95 - q05) / (top - bottom), var**0.5 / (mean + 1e-12), (at - mean) ** 3 @ p / (var**1.5 + 1e-12))
        found = pd.DataFrame(out, columns=list(FIELDS)).astype(object)
        found = found.where(found.notna(), None)
        return pd.concat([pdf[[code, date]].reset_index(drop=True), found], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    rows = panel.selectExpr(f"`{code}`", f"`{date}`", "open", "high", "low", "close", "volume", f"cast(`{turnover}` as double) AS _t")
    return rows.groupBy(code).applyInPandas(run, f"{code} {kinds[code]}, {date} {kinds[date]}, " + ", ".join(f"{n} double" for n in FIELDS))
