"""Operators that prepare training text and vectors. Nothing else in the library imports this package.

Functions that run in Spark's Python workers go there by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
