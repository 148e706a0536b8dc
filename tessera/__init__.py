"""Cohort analytics and corpus preparation on Spark.

Functions of the library travel to executors by value, so a cluster needs no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
