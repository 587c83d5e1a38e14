"""Operators that prepare training text; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
