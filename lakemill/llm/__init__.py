"""Operators for training data. Nothing else in the package imports this one.

Functions that run on executors are pickled by value, so executors need the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
