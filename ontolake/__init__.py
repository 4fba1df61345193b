"""Spark-native ontology analytics: axioms, nodes and quads as DataFrames.

Functions that run in Python workers travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
