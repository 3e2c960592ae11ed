"""axisloom: labelled sparse data (axes and fields) on Spark DataFrames.

Functions that run on executors are pickled by value, so that a session needs
no separate deployment of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
