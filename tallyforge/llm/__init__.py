"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

Executors need not have the package installed: the functions that Spark sends to them are pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
