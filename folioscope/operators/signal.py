"""Time-series estimators over one record per key (FUN-29 to FUN-31, AGG-15)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Fixed value: samples that a record must have.
LEAST = 1000


def autocorrelation(u: np.ndarray) -> np.ndarray:
    x = u - u.mean()
    n = 1 << (2 * len(x) - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[: len(x)]
    return r / r[0] if r[0] else np.zeros(len(x))


def _until(r: np.ndarray, level: float) -> int:
    below = np.nonzero(r <= level)[0]
    return int(below[0]) if len(below) else len(r)


def length_scales(u: np.ndarray, speed: float, rate: float) -> dict[str, float]:
    """FUN-31: four estimates of the integral length and their consensus: median, spread in percent."""
    if len(u) < LEAST or not np.isfinite(u).all() or speed <= 0 or rate <= 0 or u.std() == 0:
        return {}
    r = autocorrelation(u)
    area = lambda z: float(((z[1:] + z[:-1]) / 2).sum()) / rate * speed
    n = max(100, len(u) // 8)
    parts = [autocorrelation(u[i : i + n]) for i in range(0, len(u) - n + 1, max(1, n // 2))]
    mean = np.mean(parts, axis=0)
    spectrum = np.abs(np.fft.rfft(u - u.mean())) ** 2
    low = spectrum[1 : max(3, len(spectrum) // 100)].mean()
    out = {"zero": area(r[: _until(r, 0.0)]), "e_fold": _until(r, np.exp(-1)) / rate * speed, "segments": area(mean[: _until(mean, 0.0)]), "spectral": float(low / (2 * spectrum[1:].sum()) * len(u) / rate * speed)}
    v = np.array(list(out.values()))
    return out | {"median": float(np.median(v)), "spread_pct": float((v.max() - v.min()) / np.median(v) * 100) if np.median(v) else float("nan")}


def length_scale_table(samples: DataFrame, speed: float, rate: float) -> DataFrame:
    """(key, zero, e_fold, segments, spectral, median, spread_pct) of samples (key, pos, u); short or broken records have no row."""
    names = ["zero", "e_fold", "segments", "spectral", "median", "spread_pct"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = length_scales(pdf.sort_values("pos")["u"].to_numpy(dtype=float), speed, rate)
        return pd.DataFrame([[pdf["key"].iloc[0], *(got[n] for n in names)]] if got else [], columns=["key", *names])

    return samples.groupBy("key").applyInPandas(run, "key string, " + ", ".join(f"{n} double" for n in names))


def fit_decay(x: np.ndarray, tu: np.ndarray, grid: int = 400) -> tuple[float, float, float] | None:
    """FUN-29: (C, x0, b) of tu = C (x - x0)^-b: for each x0 of a grid upstream the logarithms are fitted, the best residual wins."""
    ok = np.isfinite(x) & np.isfinite(tu) & (tu > 0)
    x, tu = x[ok], tu[ok]
    if len(x) < 3:
        return None
    best = None
    span = x.max() - x.min() or 1.0
    for x0 in x.min() - span * np.geomspace(1e-3, 10, grid):
        slope, level = np.polyfit(np.log(x - x0), np.log(tu), 1)
        err = float(((np.exp(level) * (x - x0) ** slope - tu) ** 2).sum())
        if best is None or err < best[0]:
            best = (err, float(np.exp(level)), float(x0), float(-slope))
    return best[1:]
