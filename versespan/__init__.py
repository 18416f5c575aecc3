"""Spark-native analytics for verse-keyed, multi-language parallel-text corpora.

Every operator takes a DataFrame of requests and returns a DataFrame that carries the
request key, so one request and a billion requests run through the same plan.
"""

import sys

from pyspark import cloudpickle

# The two functions that run inside Python workers travel with their job, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
