"""wickwork: candle and signal analytics as PySpark DataFrame operators.

Functions that run inside Python tasks are shipped by value, so executors
need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
