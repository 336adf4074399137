"""Dense multichannel time-series analytics expressed as PySpark DataFrame plans."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so that nothing has to be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
