"""Spark-native text labelling and label-quality jobs.

Sub-packages:

* ``functions``  column expressions (text cleaning, label policies, label sets, answer parsing, vectors)
* ``operators``  DataFrame -> DataFrame building blocks (matching, ranking, metrics, kNN, models, scoring)
* ``sources``    readers and sinks
* ``plans``      end-to-end jobs made of the operators
* ``streaming``  the stateless operators applied to unbounded input
* ``queries``    the registered queries and their SQL counterparts
"""

__version__ = "0.1.0"

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions for the Python workers travel by value: executors need no copy of this package
register_pickle_by_value(sys.modules[__name__])
