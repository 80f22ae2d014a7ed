"""Operators for the preparation of text corpora, each on Spark DataFrames.

Functions that run in Python workers are shipped by value, so a cluster needs no
copy of this package on its executors (numpy, pyarrow and tokenizers it needs).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
