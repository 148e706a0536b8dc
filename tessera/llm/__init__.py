"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; ``queries`` registers what
the entry point offers from it. Its functions travel to executors by value, so
a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
