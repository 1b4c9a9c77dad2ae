"""hybridlake: corpus preparation and hybrid retrieval as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Ship this package's code inside the pickled Python functions, so executors
# need no installed copy (works the same locally and on a cluster).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
