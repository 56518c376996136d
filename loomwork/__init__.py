"""loomwork: retrieval, code analytics and corpus preparation as Spark jobs.

Operators take and return DataFrames.  Importing the package registers it for
pickling by value, so Python functions shipped to executors need no copy of
the package on the worker's path.
"""

import sys

try:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - pickling by reference still works locally
    pass
