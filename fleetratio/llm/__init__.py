"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the tasks: executors need not have this library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
