"""Operators of a training-data pipeline: scans, counts, filters, packing, search, near duplicates.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value, so that they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
