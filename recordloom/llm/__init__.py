"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this package. Its modules are pickled by value, so
executors need numpy and pyarrow (and the tokenizer libraries), but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
