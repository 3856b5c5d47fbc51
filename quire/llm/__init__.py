"""Operators for training-data pipelines; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Tasks carry this code with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
