"""A chain of spectral steps compiled for one scan layout and run on an (n_scans, n_channels) block.

Used where a table mixes many corrections: one Arrow pass reads the table once, whatever the number of corrections,
instead of one filtered branch per correction.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lumenscan.operators import weights as wt
from lumenscan.operators.weights import OperatorError
from lumenscan.rulebook import WL_TOL

Step = tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]


def to_absorbance(X: np.ndarray, clip: float) -> np.ndarray:
    return np.log10(1.0 / np.maximum(X, clip))


def _standardise(X: np.ndarray, ddof: int) -> np.ndarray:
    s = X.std(axis=1, ddof=ddof, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(s > 0, (X - X.mean(axis=1, keepdims=True)) / s, np.nan)


def _linear(op) -> Step:
    return op.apply, op.wl


def _block_columns(wl, joins, blocks) -> np.ndarray:
    picked = []
    for lo, hi in blocks:
        cols = np.flatnonzero((wl >= lo - WL_TOL) & (wl <= hi + WL_TOL))
        if len(cols) < 3:
            raise OperatorError(f"SNV block {lo:g}-{hi:g} nm has {len(cols)} grid points (needs >= 3)")
        if any(wl[cols[0]] <= j + WL_TOL and wl[cols[-1]] > j + WL_TOL for j in joins):
            raise OperatorError(f"SNV block {lo:g}-{hi:g} nm spans a detector join")
        picked.append(cols)
    return picked


def compile_step(op: dict, wl: np.ndarray, joins) -> Step:
    name, n = op["op"], len(wl)
    if name == "absorbance":
        clip = float(op.get("clip_min", 1e-3))
        return (lambda X: to_absorbance(X, clip)), wl
    if name == "crop":
        lo, hi = op["range_nm"]
        cols = np.flatnonzero((wl >= lo - WL_TOL) & (wl <= hi + WL_TOL))
        if len(cols) == 0:
            raise OperatorError("crop leaves no points")
        return (lambda X: X[:, cols]), wl[cols]
    if name == "savgol":
        return _linear(wt.savgol(wl, int(op["window"]), int(op["polyorder"]), int(op.get("deriv", 0)),
                                 float(op.get("delta", 1.0)), op.get("mode", "interp")))
    if name == "gaussian_blur":
        return _linear(wt.gaussian_blur(wl, joins, op.get("sigma_nm"), op.get("fwhm_nm"),
                                        float(op.get("truncate", 4.0)), op.get("radius", "round"),
                                        op.get("segments", "from_scan") == "none"))
    if name == "resample":
        g = op["to_grid"]
        return _linear(wt.resample(wl, g["wavelengths_nm"] if "wavelengths_nm" in g
                                   else wt.grid(g["start_nm"], g["step_nm"], int(g["n"]))))
    if name == "pds_banded":
        return _linear(wt.pds(wl, op["wavelengths_nm"], op["B"], op.get("offset")))
    if name == "detrend":
        return _linear(wt.detrend(wl, int(op.get("degree", 1))))
    if name == "snv":
        ddof = int(op.get("ddof", 0))
        if op.get("blocks_nm") is None:
            return (lambda X: _standardise(X, ddof)), wl
        blocks = _block_columns(wl, joins, op["blocks_nm"])
        return (lambda X: np.hstack([_standardise(X[:, c], ddof) for c in blocks])), wl[np.concatenate(blocks)]
    if name == "msc":
        ref = np.asarray(op["reference"], float)
        if len(ref) != n:
            raise OperatorError("MSC reference length mismatch")
        c = (ref - ref.mean()) / ((ref - ref.mean()) @ (ref - ref.mean()))

        def undo(X):
            slope = (X @ c)[:, None]
            return (X - (X.mean(axis=1, keepdims=True) - slope * ref.mean())) / slope
        return undo, wl
    segs = wt.segment_ranges(wl, joins)
    if name == "absorbance_affine":
        g = wt._per_segment(op["gain"], segs, n, "gain")
        o = wt._per_segment(op.get("offset", 0.0), segs, n, "offset")
        clip = float(op["clip_min"])
        return (lambda X: 10.0 ** -(g * to_absorbance(X, clip) + o)), wl
    if name == "affine_reflectance":
        own = op.get("joins", "from_scan")
        segs = segs if own == "from_scan" else wt.segment_ranges(wl, own)
        a = wt._per_segment([s["a"] for s in op["segments"]], segs, n, "affine_reflectance")
        b = wt._per_segment([s["b"] for s in op["segments"]], segs, n, "affine_reflectance")
        return (lambda X: a * X + b), wl
    if name == "splice_correct":
        own = joins if op.get("joins", "from_scan") == "from_scan" else op["joins"]
        if len(own) != 2:
            raise OperatorError("splice correction needs two joins on the grid")
        i1, i2 = (int(np.searchsorted(wl, j + WL_TOL, side="right")) - 1 for j in sorted(own))
        lo, hi = int(op.get("fit_points_lower", 5)), int(op.get("fit_points_upper", 6))
        if i1 < 0 or i1 + lo >= n or i2 - hi + 1 < 0 or i2 + 1 >= n:
            raise OperatorError("splice correction needs two joins on the grid")
        x1, x2 = np.arange(i1 + 1, i1 + 1 + lo), np.arange(i2 - hi + 1, i2 + 1)

        def shift(X):
            Y = X.copy()
            for cols, at, target, side in ((x1, i1, i1, slice(None, i1 + 1)), (x2, i2 + 1, i2 + 1, slice(i2 + 1, None))):
                centre = cols - cols.mean()
                slope = X[:, cols] @ centre / (centre @ centre)
                Y[:, side] += (X[:, cols].mean(axis=1) + slope * (at - cols.mean()) - X[:, target])[:, None]
            return Y
        return shift, wl
    raise OperatorError(f"unknown op {name}")


class Chain:
    """A compiled chain with the interface of a linear operator."""

    def __init__(self, ops: list[dict], wl: np.ndarray, joins):
        self.steps = []
        for op in ops:
            fn, wl = compile_step(op, wl, joins)
            self.steps.append(fn)
        self.wl = wl

    def apply(self, X: np.ndarray) -> np.ndarray:
        for fn in self.steps:
            X = fn(X)
        return X
