"""raresift: Spark operators for finding rare objects in very large catalogues."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
