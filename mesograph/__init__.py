"""Analytics over microscopy image annotations, pixels, particles and tracks, as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
