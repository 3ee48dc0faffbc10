"""BLAS thread control.

Inside Spark tasks numpy's BLAS runs single-threaded: Spark already runs one
task per core, and a multi-threaded BLAS in every Python worker oversubscribes
the cores (several times slower on the small m x m matrices used here).  The
driver's algebra is single-threaded too (see ``driver_blas_for``).  Uses ``threadpoolctl`` when present,
otherwise the OpenBLAS entry point bundled with numpy.
"""

from __future__ import annotations

import ctypes
import glob
import os

_current = None   # only plain values at module level: the package is pickled by value


def _find_setter():
    """Looked up per call (no ctypes handle kept in module state)."""
    try:
        from threadpoolctl import threadpool_limits  # type: ignore

        return lambda k: threadpool_limits(k)
    except Exception:
        pass
    try:
        import numpy

        base = os.path.dirname(numpy.__file__)
        for lib in glob.glob(os.path.join(base, "..", "numpy.libs", "*openblas*")):
            h = ctypes.CDLL(lib)
            for sym in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_",
                        "openblas_set_num_threads"):
                fn = getattr(h, sym, None)
                if fn is not None:
                    return lambda k, fn=fn: fn(int(k))
    except Exception:
        pass
    return lambda k: None


def set_blas_threads(k: int) -> None:
    global _current
    if k != _current:
        _find_setter()(k)
        _current = k


def single_thread_blas() -> None:
    """Called at the start of every numpy-heavy task."""
    set_blas_threads(1)


def driver_blas_for(m: int) -> None:
    """Driver side: one thread as well.  Measured locally: multi-threaded OpenBLAS
    is 2-3x faster on an idle 850 x 850 decomposition, but its spinning threads
    take cores from the executors and the whole fit became 2x slower."""
    set_blas_threads(1)
