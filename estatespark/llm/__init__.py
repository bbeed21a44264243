"""Operators that prepare text corpora for training: filters, deduplication, mixing, tokens and chat formatting."""

import sys

from pyspark import cloudpickle

# Tasks receive this package's functions and classes by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
