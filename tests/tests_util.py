"""Slow, direct versions used as expectations."""
import math

import numpy as np


def poly_eval(y, p, d, at):
    h = len(y) // 2
    c = np.polynomial.Polynomial.fit(np.arange(-h, h + 1), y, p).convert()
    return c.deriv(d)(at) if d else c(at)


def brute_blur(wl, X, joins, sigma_nm=None, fwhm_nm=None, radius="round", segments="from_scan", truncate=4.0):
    n = len(wl)
    seg = np.zeros(n, int) if segments == "none" else sum((wl > j + 1e-6).astype(int) for j in joins)
    if sigma_nm is None:
        sig = np.interp(wl, fwhm_nm["knots_nm"], fwhm_nm["values_nm"]) / (2 * math.sqrt(2 * math.log(2)))
    else:
        sig = np.full(n, sigma_nm) if isinstance(sigma_nm, float) else np.array(sigma_nm)[seg]
    Y = X.copy()
    for i in range(n):
        if sig[i] <= 0:
            continue
        r = math.ceil(truncate * sig[i]) if radius == "ceil" else math.floor(truncate * sig[i] + 0.5)
        k = [j for j in range(n) if abs(j - i) <= r and seg[j] == seg[i]]
        w = np.exp(-0.5 * ((wl[k] - wl[i]) / sig[i]) ** 2)
        Y[:, i] = X[:, k] @ w / w.sum()
    return Y


def n2(r, wl, lo, hi):
    a = np.log10(1 / np.clip(r, 1e-4, None))
    d = a[2:] - 2 * a[1:-1] + a[:-2]
    d = d[(wl[1:-1] >= lo) & (wl[1:-1] < hi)]
    d = d[np.isfinite(d)]
    return None if len(d) == 0 else 1.4826 * np.median(np.abs(d - np.median(d))) * 1e5


def derivative(r, wl, window, p, clip, scale):
    a = np.log10(1 / np.maximum(r, clip))
    h = window // 2
    A = np.vander(np.arange(-h, h + 1.0), p + 1, increasing=True)
    c = 2 * np.linalg.pinv(A)[2]
    out = np.full(len(r), np.nan)
    for i in range(h, len(r) - h):
        out[i] = scale * (c @ a[i - h:i + h + 1])
    return out
