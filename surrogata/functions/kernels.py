"""FN-7: stationary kernels with ARD lengthscales, vectorised in numpy.

These run inside Arrow batches on executors (``mapInArrow``) and on the driver
for the m x m inducing-point matrix.  All kernels have unit output scale; the
scale enters the model algebra separately.
"""

from __future__ import annotations

import numpy as np

SQRT3 = np.sqrt(3.0)
SQRT5 = np.sqrt(5.0)


def scaled_sqdist(A: np.ndarray, B: np.ndarray, lengthscale: np.ndarray) -> np.ndarray:
    """Squared distance of rows of A and B after dividing by the lengthscales."""
    a = A / lengthscale
    b = B / lengthscale
    aa = np.einsum("ij,ij->i", a, a)[:, None]
    bb = np.einsum("ij,ij->i", b, b)[None, :]
    d2 = a @ b.T
    d2 *= 2.0
    np.subtract(aa + bb, d2, out=d2)
    np.maximum(d2, 0.0, out=d2)
    return d2


def _matern52(sq):
    s = np.sqrt(sq)
    s *= SQRT5
    out = s * s
    out /= 3.0
    out += 1.0 + s
    np.negative(s, out=s)
    out *= np.exp(s, out=s)
    return out


def _matern32(sq):
    s = SQRT3 * np.sqrt(sq)
    return (1.0 + s) * np.exp(-s)


def _rbf(sq):
    return np.exp(-0.5 * sq)


OF_SQDIST = {"matern_5_2": _matern52, "matern_3_2": _matern32, "rbf": _rbf}


def kernel_of_sqdist(name: str, sq: np.ndarray) -> np.ndarray:
    """The kernel of scaled squared distances."""
    return OF_SQDIST[name](sq)


def matern52(A, B, lengthscale):
    return _matern52(scaled_sqdist(A, B, lengthscale))


def matern32(A, B, lengthscale):
    return _matern32(scaled_sqdist(A, B, lengthscale))


def rbf(A, B, lengthscale):
    return _rbf(scaled_sqdist(A, B, lengthscale))


KERNELS = {"matern_5_2": matern52, "matern_3_2": matern32, "rbf": rbf}


def get_kernel(name: str):
    try:
        return KERNELS[name]
    except KeyError:
        raise ValueError(f"unknown kernel {name!r}; expected one of {sorted(KERNELS)}") from None
