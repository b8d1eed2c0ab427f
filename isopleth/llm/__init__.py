"""Operators for preparing text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with the job, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
