"""Analytics over digitised textbooks and learning activity, as DataFrame and column functions."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks are shipped by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
