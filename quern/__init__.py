"""quern: a PySpark-native engine that refines version-control history into training data."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers may not have this package on their path: its functions travel with the tasks.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
