"""Wavelets by lifting, along any axis of NumPy arrays, for lines of any length.

A step splits a line in its samples at even places (the approximation, which has one more where the
length is odd) and at odd places (the details), and changes one by a weighted sum of the
other, in turn.  Lines are continued by reflection, about the first and last sample for families of odd filter
length, about the ends beside them for those of even length, so the inverse is exact whatever the length.
Approximations are larger than samples by sqrt(2) for each step and axis, but for the integer family, which
leaves their size and gives integers for integers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

ROOT = math.sqrt(2.0)

# Lifting weights by family.  A step is (what changes, weights of the pairs beside it, from the inside out).
STEPS: dict[str, list[tuple[str, tuple[float, ...]]]] = {
    "bior2.2": [("detail", (-1 / 2,)), ("approx", (1 / 4,))],
    "bior2.4": [("detail", (-1 / 2,)), ("approx", (19 / 64, -3 / 64))],
    "bior2.6": [("detail", (-1 / 2,)), ("approx", (162 / 512, -39 / 512, 5 / 512))],
    "bior4.4": [
        ("detail", (-1.586134342059924,)), ("approx", (-0.052980118572961,)), ("detail", (0.882911075530934,)), ("approx", (0.443506852043971,)),
    ],
}
#: The final factor of the approximation; details have its inverse.
SCALE = {"bior2.2": ROOT, "bior2.4": ROOT, "bior2.6": ROOT, "bior4.4": 1.149604398860241}
#: Weight of the difference of the details beside a pair, for families of even length.
EVEN = {"haar": 0.0, "bior1.3": 1 / 16}
FAMILIES = (*EVEN, *STEPS, "intbior2.2")
#: Filter lengths, which bound the number of steps.
TAPS = {"haar": 2, "bior1.3": 6, "bior2.2": 6, "bior2.4": 10, "bior2.6": 14, "bior4.4": 10, "intbior2.2": 6}


def max_steps(n: int, family: str) -> int:
    """Steps that keep a line of n samples as long as the filter."""
    taps = TAPS[family]
    return max(0, int(math.log2(n / (taps - 1)))) if n >= taps else 0


def _reflected(place: np.ndarray, n: int) -> np.ndarray:
    """Places continued by reflection about the first and last of n."""
    if n == 1:
        return np.zeros_like(place)
    place = np.abs(place) % (2 * n - 2)
    return np.where(place < n, place, 2 * n - 2 - place)


def _beside(other: np.ndarray, which: str, count: int, n: int, far: int) -> np.ndarray:
    """The sum of the two samples of the other kind that are ``far`` pairs away from each of ``count`` samples."""
    at = 2 * np.arange(count) + (which == "detail")
    low, high = (_reflected(at + d * (2 * far + 1), n) // 2 for d in (-1, 1))
    return other[..., low] + other[..., high]


def _lift(approx: np.ndarray, detail: np.ndarray, which: str, weights: Sequence[float], n: int, sign: float) -> None:
    changed, other = (detail, approx) if which == "detail" else (approx, detail)
    total = None
    for far, w in enumerate(weights):
        part = _beside(other, which, changed.shape[-1], n, far) * w
        total = part if total is None else total + part
    changed += sign * total


def _difference(detail: np.ndarray, count: int, n: int) -> np.ndarray:
    """Of the details before and after each pair, reflected with their sign turned; the half pair of an odd length has none."""
    wide = np.concatenate([detail, np.zeros((*detail.shape[:-1], n % 2))], axis=-1)
    before = np.concatenate([-wide[..., :1], wide[..., :-1]], axis=-1)
    last = -wide[..., -2:-1] if n % 2 else -wide[..., -1:]
    after = np.concatenate([wide[..., 1:], last], axis=-1)
    return (before - after)[..., :count]


def forward(samples: np.ndarray, family: str, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(approximation, details) of one step along an axis."""
    x = np.moveaxis(np.asarray(samples), axis, -1)
    n = x.shape[-1]
    if family == "intbior2.2":
        x = x.astype(np.int64)
        a, d = x[..., ::2].copy(), x[..., 1::2].copy()
        if n > 1:
            d -= _beside(a, "detail", d.shape[-1], n, 0) >> 1
            a += (_beside(d, "approx", a.shape[-1], n, 0) + 2) >> 2
    elif family in EVEN:
        x = x.astype(float)
        first, second = x[..., ::2], x[..., 1::2]
        if n % 2:
            second = np.concatenate([second, x[..., -1:]], axis=-1)
        a, d = (first + second) * (1 / ROOT), ((first - second) * (1 / ROOT))[..., : n // 2]
        if EVEN[family] and n > 1:
            a -= 2 * EVEN[family] * _difference(d, a.shape[-1], n)  # d has the sign of first less second
    else:
        x = x.astype(float)
        a, d = x[..., ::2].copy(), x[..., 1::2].copy()
        if n > 1:
            for which, weights in STEPS[family]:
                _lift(a, d, which, weights, n, 1.0)
            a, d = a * SCALE[family], d / SCALE[family]
        else:
            a = a * ROOT
    return np.moveaxis(a, -1, axis), np.moveaxis(d, -1, axis)


def inverse(approx: np.ndarray, detail: np.ndarray, family: str, axis: int = -1) -> np.ndarray:
    """The samples of one step's approximation and details."""
    kind = np.int64 if family == "intbior2.2" else float
    a, d = (np.moveaxis(np.asarray(v), axis, -1).astype(kind) for v in (approx, detail))
    n = a.shape[-1] + d.shape[-1]
    out = np.empty((*a.shape[:-1], n), kind)
    if family == "intbior2.2":
        if n > 1:
            a = a - ((_beside(d, "approx", a.shape[-1], n, 0) + 2) >> 2)
            d = d + (_beside(a, "detail", d.shape[-1], n, 0) >> 1)
    elif family in EVEN:
        if EVEN[family] and n > 1:
            a = a + 2 * EVEN[family] * _difference(d, a.shape[-1], n)
        wide = np.concatenate([d, np.zeros((*d.shape[:-1], n % 2))], axis=-1)
        a, d = (a + wide) * (1 / ROOT), ((a - wide) * (1 / ROOT))[..., : n // 2]
    elif n > 1:
        a, d = a / SCALE[family], d * SCALE[family]
        for which, weights in reversed(STEPS[family]):
            _lift(a, d, which, weights, n, -1.0)
    else:
        a = a / ROOT
    out[..., ::2], out[..., 1::2] = a, d
    return np.moveaxis(out, -1, axis)


def shapes(shape: Sequence[int], steps: int) -> list[tuple[int, ...]]:
    """The approximation's shape after 0, 1, ... steps along all axes."""
    out = [tuple(shape)]
    for _ in range(steps):
        out.append(tuple(-(-n // 2) for n in out[-1]))
    return out


def decompose(samples: np.ndarray, family: str, steps: int, axes: Sequence[int] | None = None) -> list[np.ndarray]:
    """Flat coefficients by level: the coarsest approximation, then details from the coarsest to the finest.

    A level's details are its bands one after the other; a band's number has a bit for each axis
    along which it is a detail, the last axis lowest.  ``axes`` are the last ones if not given.
    """
    axes = range(samples.ndim) if axes is None else axes
    out, current = [], samples
    for _ in range(steps):
        bands = {0: current}
        for bit, axis in enumerate(reversed(list(axes))):
            split = {}
            for number, band in bands.items():
                split[number], split[number | 1 << bit] = forward(band, family, axis)
            bands = split
        out.append(np.concatenate([bands[k].ravel() for k in sorted(bands) if k]))
        current = bands[0]
    return [current.ravel(), *reversed(out)]


def reconstruct(levels: Sequence[np.ndarray], shape: Sequence[int], family: str, steps: int, upto: int | None = None) -> np.ndarray:
    """The samples of an array of ``shape`` from its coefficients by level, or its approximation after
    ``steps - upto`` steps in the size of samples."""
    upto = steps if upto is None else upto
    sizes = shapes(shape, steps)
    current = np.asarray(levels[0]).reshape(sizes[steps])
    for level in range(1, upto + 1):
        whole, half = sizes[steps - level], sizes[steps - level + 1]
        bands, at = {0: current}, 0
        for number in range(1, 1 << len(shape)):
            own = [w - h if number >> (len(shape) - 1 - a) & 1 else h for a, (w, h) in enumerate(zip(whole, half))]
            count = math.prod(own)
            bands[number] = np.asarray(levels[level][at : at + count]).reshape(own)
            at += count
        for bit in reversed(range(len(shape))):
            axis = len(shape) - 1 - bit
            bands = {k: inverse(band, bands[k | 1 << bit], family, axis) for k, band in bands.items() if not k >> bit}
        current = bands[0]
    down = steps - upto
    return current if family == "intbior2.2" or not down else current * (1 / ROOT) ** (down * len(shape))
