"""Training-data operators: cleaning, de-duplication, tokenisation and filtering of text corpora.

Each module holds one operator; ``queries`` maps the registered query names to them. The functions
that run inside tasks are shipped by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
