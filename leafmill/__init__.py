"""Serial-page analytics on Spark: every operator is DataFrame -> DataFrame or Column -> Column.

Functions that run in tasks are pickled by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
