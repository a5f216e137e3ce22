"""Strataquill: document-retrieval analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so these need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
