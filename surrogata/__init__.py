"""surrogata — Spark-native building, scoring and comparison of statistical emulators.

Every row-sized step runs on Spark executors; the driver only holds model state
whose size is bounded by the number of inducing points, components or features.
"""

import sys as _sys

__version__ = "0.1.0"

# Ship the package's functions to executors inside the task closures, so a
# cluster needs no installed copy of it (PySpark's bundled cloudpickle).
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from surrogata.session import get_spark, checkpoint_dir  # noqa: E402,F401
