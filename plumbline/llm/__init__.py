"""Operators of a training-data pipeline.

Functions that run in tasks are sent to the executors by value, so that workers need not
have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
