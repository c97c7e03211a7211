"""pairlab: Spark-native operators for scored query-document pair tables."""

import sys

__version__ = "0.1.0"

# Python functions of this package that run on executors (pandas UDFs, the
# mapInPandas scorer) are serialised by value, so executors need no installed
# copy of the package — on a cluster, or in any worker whose path lacks it.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - an older cloudpickle: ship the package instead
    pass
