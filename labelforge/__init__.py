"""Label analytics on Spark: extraction, matching, evaluation and corpus operators as DataFrame functions."""

import sys

from pyspark import cloudpickle

# Executors get this package's Python functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
