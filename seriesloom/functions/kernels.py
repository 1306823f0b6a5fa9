"""Arrow-vectorised kernels on array<double> columns, for what window functions cannot express.

Each is a pandas UDF over one row a window; register() makes them callable from SQL.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_INT, _DOUBLE = T.IntegerType(), T.DoubleType()
PERIOD = _struct(has=T.BooleanType(), period=_INT, strength=_DOUBLE)


def _acf(x: np.ndarray, max_lag: int) -> np.ndarray | None:
    """Autocorrelation at lags 1..max_lag of the detrended series, each sum over n - lag terms; None if flat."""
    n = len(x)
    t = np.arange(n) - (n - 1) / 2
    y = x - x.mean()
    y = y - (t @ y) / (t @ t) * t
    y -= y.mean()
    if y.var() < 1e-8:
        return None
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(y, size)
    dots = np.fft.irfft(spectrum * np.conj(spectrum), size)[1 : max_lag + 1]
    return dots / ((n - np.arange(1, max_lag + 1)) * y.var())


def acf_of(values, max_lag: int = 200, least: float = 0.3) -> tuple[bool, int | None, float]:
    """The strongest strict local maximum of the autocorrelation; without one, only its greatest value."""
    x = np.asarray(values, float)
    if len(x) < 6:
        return False, None, 0.0
    acf = _acf(x, min(max_lag, len(x) - 2))
    if acf is None:
        return False, None, 0.0
    inner = np.flatnonzero((acf[1:-1] > acf[:-2]) & (acf[1:-1] > acf[2:]) & (acf[1:-1] >= least)) + 1
    if not len(inner):
        return False, None, float(acf.max())
    best = inner[np.argmax(acf[inner])]
    return True, int(best) + 1, float(acf[best])


def spectrum_of(values) -> tuple[int | None, float]:
    """The strongest Hann-window frequency strictly between 2/n and 0.4, and its share of that band's power."""
    x = np.asarray(values, float)
    n = len(x)
    if n < 10:
        return None, 0.0
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    centred = x - x.mean()
    power = np.abs(np.fft.rfft(taper * (centred - centred.mean()))) ** 2 / taper.sum() ** 2
    power[1 : len(power) - (n % 2 == 0)] *= 2
    frequency = np.arange(len(power)) / n
    band = (frequency > 2 / n) & (frequency < 0.4)
    if not band.any():
        return None, 0.0
    at = np.argmax(power[band])
    return int(round(1 / frequency[band][at])), float(power[band][at] / (power[band].sum() + 1e-9))


def fused(acf: tuple, fft: tuple) -> tuple[bool, int | None, float]:
    """One verdict from both: agreement within 15 % takes the greater strength, else the clearly stronger one."""
    has, period, strength = acf
    other, share = fft
    if other is None or share <= 0.15:
        return acf
    if not has:
        return True, other, share
    if abs(period - other) / period < 0.15:
        return True, period, max(strength, share)
    return (True, other, share) if share > 0.4 and strength < 0.4 else acf


def _cap(n: int) -> int:
    return min(200, n // 2)


#: Numbers of windows of one length that are computed at once.
AT_ONCE = 1 << 15


def _alike(values: pd.Series):
    """The windows of a batch by length: their places and a matrix with a row each, of about AT_ONCE numbers."""
    sizes = np.array([len(v) for v in values], int)
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        step = max(1, AT_ONCE // max(n, 1))
        for own in (places[k : k + step] for k in range(0, len(places), step)):
            yield own, np.array([np.asarray(values.iloc[k], float) for k in own]).reshape(len(own), n)


def acf_rows(x: np.ndarray, max_lag: int, least: float = 0.3) -> list[tuple[bool, int | None, float]]:
    """acf_of() of each row."""
    n = x.shape[1]
    most = min(max_lag, n - 2)
    if n < 6 or most < 3:
        return [acf_of(row, max_lag, least) for row in x]
    t = np.arange(n) - (n - 1) / 2
    y = x - x.mean(axis=1, keepdims=True)
    y = y - ((y * t).sum(axis=1) / (t @ t))[:, None] * t
    y -= y.mean(axis=1, keepdims=True)
    var = y.var(axis=1)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(y, size)
    dots = np.fft.irfft(spectrum * np.conj(spectrum), size)[:, 1 : most + 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        acf = dots / ((n - np.arange(1, most + 1)) * var[:, None])
        inner = (acf[:, 1:-1] > acf[:, :-2]) & (acf[:, 1:-1] > acf[:, 2:]) & (acf[:, 1:-1] >= least)
    best = np.where(inner, acf[:, 1:-1], -np.inf).argmax(axis=1) + 1
    return [(False, None, 0.0) if v < 1e-8 else (True, int(k) + 1, float(row[k])) if i.any() else (False, None, float(row.max())) for v, i, k, row in zip(var, inner, best, acf, strict=True)]


def spectrum_rows(x: np.ndarray) -> list[tuple[int | None, float]]:
    """spectrum_of() of each row."""
    n = x.shape[1]
    frequency = np.arange(n // 2 + 1) / max(n, 1)
    band = (frequency > 2 / max(n, 1)) & (frequency < 0.4)
    if n < 10 or not band.any():
        return [(None, 0.0)] * len(x)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    centred = x - x.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(taper * (centred - centred.mean(axis=1, keepdims=True)))) ** 2 / taper.sum() ** 2
    power[:, 1 : power.shape[1] - (n % 2 == 0)] *= 2
    inside = power[:, band]
    at = inside.argmax(axis=1)
    share = inside[np.arange(len(x)), at] / (inside.sum(axis=1) + 1e-9)
    return [(int(round(1 / f)), float(v)) for f, v in zip(frequency[band][at], share, strict=True)]


def _periods(values: pd.Series, verdicts, columns: list[str]) -> pd.DataFrame:
    rows = [None] * len(values)
    for places, x in _alike(values):
        for k, row in zip(places, verdicts(x), strict=True):
            rows[k] = row
    return pd.DataFrame(rows, columns=columns).astype({"period": "Int32"})


@F.pandas_udf(PERIOD)
def acf_period(values: pd.Series) -> pd.DataFrame:
    return _periods(values, lambda x: acf_rows(x, _cap(x.shape[1])), ["has", "period", "strength"])


@F.pandas_udf(_struct(period=_INT, strength=_DOUBLE))
def fft_period(values: pd.Series) -> pd.DataFrame:
    return _periods(values, spectrum_rows, ["period", "strength"])


@F.pandas_udf(PERIOD)
def season(values: pd.Series) -> pd.DataFrame:
    both = lambda x: map(fused, acf_rows(x, _cap(x.shape[1])), spectrum_rows(x))
    return _periods(values, both, ["has", "period", "strength"])


@F.pandas_udf(_struct(lag=_INT, strength=_DOUBLE))
def dominant_lag(values: pd.Series) -> pd.DataFrame:
    """The lag in 1..min(n/2, 200) of greatest centred autocorrelation over lag 0 (no detrending)."""
    rows = []
    for v in values:
        y = np.asarray(v, float)
        y = y - y.mean()
        zero, most = y @ y, min(len(y) // 2, 200)
        if zero < 1e-12 or most < 1:
            rows.append((None, 0.0))
            continue
        acf = np.array([y[k:] @ y[:-k] for k in range(1, most + 1)]) / zero
        rows.append((int(np.argmax(acf)) + 1, float(acf.max())))
    return pd.DataFrame(rows, columns=["lag", "strength"]).astype({"lag": "Int32"})


def _pearson(a: np.ndarray, b: np.ndarray) -> float | None:
    known = np.isfinite(a) & np.isfinite(b)
    a, b = a[known], b[known]
    if len(a) < 8 or a.std() < 1e-8 or b.std() < 1e-8:
        return None
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def best_pearson(y: np.ndarray, x: np.ndarray, max_lag: int) -> tuple[float, int]:
    best, at = 0.0, 0
    for lag in range(-max_lag, max_lag + 1):
        a, b = (y[lag:], x[: len(y) - lag]) if lag >= 0 else (y[:lag], x[-lag:])
        if len(a) >= 8 and (c := _pearson(a, b)) is not None and abs(c) > abs(best):
            best, at = c, lag
    return best, at


@functools.lru_cache(maxsize=64)
def _shifts(n: int, max_lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each lag that leaves at least 8 of n places: the lag, the place i + lag for each place i, and whether it exists."""
    lags = np.arange(-max_lag, max_lag + 1)
    lags = lags[n - np.abs(lags) >= 8]
    at = np.arange(n) + lags[:, None]
    return lags, np.clip(at, 0, n - 1), ((at >= 0) & (at < n)).astype(float)


def _lag_sums(y: np.ndarray, x: np.ndarray, max_lag: int):
    """Lags, pairs of each, and by lag and column of x the sums of y, y*y, x, x*x and x*y over the pairs (y[i + lag], x[i])."""
    n = len(y)
    if n <= 1024:
        lags, at, there = _shifts(n, max_lag)
        moved = y[at] * there
        return lags, there.sum(axis=1)[:, None], moved.sum(axis=1)[:, None], (moved * moved).sum(axis=1)[:, None], there @ x, there @ (x * x), moved @ x
    lags, rows = np.arange(-max_lag, max_lag + 1), []  # a long window: lag by lag, without copies of it
    lags = lags[n - np.abs(lags) >= 8]
    for lag in lags:
        a, b = (y[lag:], x[: n - lag]) if lag >= 0 else (y[:lag], x[-lag:])
        rows.append(([len(a)], [a.sum()], [a @ a], b.sum(axis=0), np.einsum("ij,ij->j", b, b), a @ b))
    return lags, *(np.array(column, float) for column in zip(*rows, strict=True))


def _greatest(c: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column the value of greatest size and its lag, the first on ties; 0 at lag 0 if no value is known."""
    size = np.nan_to_num(np.abs(c), nan=0.0)
    if not len(lags):
        return np.zeros(c.shape[1]), np.zeros(c.shape[1], int)
    best = size.argmax(axis=0)
    column = np.arange(c.shape[1])
    known = size[best, column] > 0
    return np.where(known, c[best, column], 0.0), np.where(known, lags[best], 0)


def best_cosine(y: np.ndarray, x: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Per column of x: the cosine of greatest size between slices of z-scores, and its lag (first on ties)."""
    y = (y - y.mean()) / (y.std() + 1e-9)
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    lags, _, _, yy, _, xx, xy = _lag_sums(y, x, max_lag)
    return _greatest(xy / (np.sqrt(xx) * np.sqrt(yy) + 1e-9), lags)


def best_pearsons(y: np.ndarray, x: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """best_pearson() for every column of x, from sums by lag; columns with gaps, and lags at which a slice hardly
    varies (where differences of sums would be noise), are computed pair by pair."""
    whole = np.isfinite(x).all(axis=0) & np.isfinite(y).all()
    corr, at = np.zeros(x.shape[1]), np.zeros(x.shape[1], int)
    for k in np.flatnonzero(~whole):
        corr[k], at[k] = best_pearson(y, x[:, k], max_lag)
    if not whole.any() or len(y) < 8:
        return corr, at
    y, x = y - y.mean(), x[:, whole] - x[:, whole].mean(axis=0)
    lags, n, sy, yy, sx, xx, xy = _lag_sums(y, x, max_lag)
    vy, vx = yy - sy * sy / n, xx - sx * sx / n
    unsure = (vy <= np.maximum(1e-9 * (y @ y), 1e-13 * n)) | (vx <= np.maximum(1e-9 * (x * x).sum(axis=0), 1e-13 * n))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = (xy - sx * sy / n) / np.sqrt(vx * vy)
    for i, k in zip(*np.nonzero(unsure), strict=True):
        lag = lags[i]
        a, b = (y[lag:], x[: len(y) - lag, k]) if lag >= 0 else (y[:lag], x[-lag:, k])
        exact = _pearson(a, b)
        c[i, k] = np.nan if exact is None else exact
    corr[whole], at[whole] = _greatest(c, lags)
    return corr, at


CORR = T.ArrayType(_struct(var=_INT, corr=_DOUBLE, lag=_INT, corr_1=_DOUBLE, lag_1=_INT, corr_2=_DOUBLE, lag_2=_INT))


def _lag_rows(y: np.ndarray, x: np.ndarray, max_lag: int):
    """_lag_sums() of many windows of one length, y by window and place, x by window, column and place: each sum by lag,
    window and column."""
    n, yy_, xx_, rows = y.shape[1], y * y, x * x, []
    lags = np.arange(-max_lag, max_lag + 1)
    lags = lags[n - np.abs(lags) >= 8]
    for lag in lags:
        a, b = (slice(lag, n), slice(0, n - lag)) if lag >= 0 else (slice(0, n + lag), slice(-lag, n))
        rows.append((y[:, a].sum(axis=1)[:, None], yy_[:, a].sum(axis=1)[:, None], x[:, :, b].sum(axis=2), xx_[:, :, b].sum(axis=2), np.einsum("wi,wvi->wv", y[:, a], x[:, :, b])))
    return lags, (n - np.abs(lags)).astype(float)[:, None, None], *(np.array(column) for column in zip(*rows, strict=True))


def _greatest_rows(c: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_greatest() by window and column."""
    flat = c.reshape(len(lags), -1)
    value, at = _greatest(flat, lags)
    return value.reshape(c.shape[1:]), at.reshape(c.shape[1:])


def cosine_rows(y: np.ndarray, x: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """best_cosine() of many windows."""
    if y.shape[1] < 8:
        return np.zeros(x.shape[:2]), np.zeros(x.shape[:2], int)
    y = (y - y.mean(axis=1, keepdims=True)) / (y.std(axis=1, keepdims=True) + 1e-9)
    x = (x - x.mean(axis=2, keepdims=True)) / (x.std(axis=2, keepdims=True) + 1e-9)
    lags, _, _, yy, _, xx, xy = _lag_rows(y, x, max_lag)
    return _greatest_rows(xy / (np.sqrt(xx) * np.sqrt(yy) + 1e-9), lags)


def pearson_rows(y: np.ndarray, x: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """best_pearsons() of many windows without gaps; those with a slice that hardly varies one by one."""
    if y.shape[1] < 8:
        return np.zeros(x.shape[:2]), np.zeros(x.shape[:2], int)
    own, other = y - y.mean(axis=1, keepdims=True), x - x.mean(axis=2, keepdims=True)
    lags, n, sy, yy, sx, xx, xy = _lag_rows(own, other, max_lag)
    vy, vx = yy - sy * sy / n, xx - sx * sx / n
    size = y.shape[1]
    unsure = (vy <= np.maximum(1e-9 * (own * own).sum(axis=1), 1e-13 * size)[None, :, None]) | (vx <= np.maximum(1e-9 * (other * other).sum(axis=2), 1e-13 * size)[None])
    with np.errstate(invalid="ignore", divide="ignore"):
        corr, at = _greatest_rows((xy - sx * sy / n) / np.sqrt(vx * vy), lags)
    for w in np.flatnonzero(unsure.any(axis=(0, 2))):
        corr[w], at[w] = best_pearsons(y[w], x[w].T, max_lag)
    return corr, at


@F.pandas_udf(CORR)
def lagged_corr(target: pd.Series, candidates: pd.Series) -> pd.Series:
    """Best lag in -24..24 of every candidate against the target, on the window and on its halves. Windows of one length
    and number of candidates are computed together; those with gaps and long ones alone."""
    out = [[] for _ in target]
    for places, ys in _alike(target):
        n, half = ys.shape[1], ys.shape[1] // 2
        if n < 20:
            continue
        lists = [[np.asarray(v, float) for v in candidates.iloc[k]] for k in places]
        many = np.array([len(v) for v in lists])
        for count in np.unique(many[many > 0]):
            own = np.flatnonzero(many == count)
            x, y = np.array([lists[k] for k in own]), ys[own]
            whole = np.isfinite(y).all(axis=1) & np.isfinite(x).all(axis=(1, 2)) & (n <= 1024)
            found = {}
            if whole.any():
                a, b = y[whole], x[whole]
                parts = cosine_rows(a, b, 24), pearson_rows(a[:, :half], b[:, :, :half], 24), pearson_rows(a[:, half:], b[:, :, half:], 24)
                found = {k: [p[j] for part in parts for p in part] for j, k in enumerate(np.flatnonzero(whole))}
            for k in np.flatnonzero(~whole):
                a, b = y[k], x[k].T
                found[k] = [p for part in (best_cosine(a, b, 24), best_pearsons(a[:half], b[:half], 24), best_pearsons(a[half:], b[half:], 24)) for p in part]
            for k, (corr, lag, c1, l1, c2, l2) in found.items():
                out[places[own[k]]] = [{"var": v, "corr": float(corr[v]), "lag": int(lag[v]), "corr_1": float(c1[v]), "lag_1": int(l1[v]), "corr_2": float(c2[v]), "lag_2": int(l2[v])} for v in range(count)]
    return pd.Series(out)


def _iou(a: tuple[int, int], b: tuple[int, int]) -> float:
    common = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)
    return common / (a[1] - a[0] + b[1] - b[0] + 2 - common) if common else 0.0


def mmr_of(spans: list[tuple[int, int, float]], k: int = 5, penalty: float = 25.0, bonus: float = 8.0) -> list[int]:
    """Places of up to k spans (start, end, score), in time order. The strongest comes first; then, again and again,
    the one of greatest score less its overlap with those chosen, plus a bonus if its start lies in a k-th of the
    covered range that no chosen one starts in. Ties go to the stronger, then the earlier place."""
    if not spans:
        return []
    low, high = min(s[0] for s in spans), max(s[1] for s in spans)
    bucket = [min(k - 1, int((s[0] - low) / (high - low + 1) * k)) for s in spans]
    order = sorted(range(len(spans)), key=lambda i: -spans[i][2])
    chosen, left = order[:1], order[1:]
    while left and len(chosen) < k:
        used = {bucket[j] for j in chosen}
        gains = [spans[i][2] - penalty * max(_iou(spans[i][:2], spans[j][:2]) for j in chosen) + bonus * (bucket[i] not in used) for i in left]
        chosen.append(left.pop(int(np.argmax(gains))))
    return sorted(chosen, key=lambda i: spans[i][0])


@F.pandas_udf(T.ArrayType(_INT))
def select_mmr(spans: pd.Series) -> pd.Series:
    return pd.Series([mmr_of([(s["start"], s["end"], s["score"]) for s in own]) for own in spans])


_WORD = re.compile(r"[a-z0-9]+")


def rouge_l_of(reference: str | None, hypothesis: str | None) -> float:
    """F-measure of the longest common subsequence of lower-case alphanumeric words."""
    a, b = _WORD.findall((reference or "").lower()), _WORD.findall((hypothesis or "").lower())
    if not a or not b:
        return 0.0
    # bit-parallel: one integer holds a row of the table
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


@F.pandas_udf(_DOUBLE)
def rouge_l(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_of(a, b) for a, b in zip(reference, hypothesis, strict=True)])


def clipped_of(reference: list[str], hypothesis: list[str], most: int = 4) -> list[int]:
    """For orders 1..most, the n-grams of the hypothesis that the reference has, counted at most as often as there; then
    the numbers of n-grams of the hypothesis."""
    matched, total = [], []
    for n in range(1, most + 1):
        a, b = (Counter(zip(*[words[k:] for k in range(n)], strict=False)) for words in (reference, hypothesis))
        matched.append(sum((a & b).values()))
        total.append(max(len(hypothesis) - n + 1, 0))
    return matched + total


@F.pandas_udf(_struct(**{f"{side}_{n}": T.LongType() for side in ("matched", "total") for n in range(1, 5)}))
def clipped_grams(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clipped_of(list(a), list(b)) for a, b in zip(reference, hypothesis, strict=True)], columns=[f"{side}_{n}" for side in ("matched", "total") for n in range(1, 5)])


def register(spark: SparkSession) -> None:
    """Makes the kernels callable from SQL."""
    for name, fn in {"acf_period": acf_period, "fft_period": fft_period, "season": season, "dominant_lag": dominant_lag, "lagged_corr": lagged_corr, "select_mmr": select_mmr, "rouge_l": rouge_l, "clipped_grams": clipped_grams}.items():
        spark.udf.register(name, fn)
