"""Operators that prepare text corpora for training.

What runs on the executors is sent there by value: they need numpy, pyarrow and
the libraries that an operator uses, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
