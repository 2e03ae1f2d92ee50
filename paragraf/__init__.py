"""paragraf: a Spark-native engine for legal corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
