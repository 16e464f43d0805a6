"""Document-text analytics and training-data preparation on Spark.

The package's own functions are shipped to Python workers by value, so that
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
