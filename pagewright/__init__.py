"""pagewright: document analytics on Spark DataFrames.

Kernels that run in Python workers are pickled by value, so executors need numpy, pandas and
pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
