"""Operators for preparing training data; nothing else in the library imports this subpackage.

Functions for executors travel by value, so workers need not have the repository on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
