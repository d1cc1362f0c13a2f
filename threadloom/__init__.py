"""threadloom: topic analytics for large collections of forum posts, on Spark.

Every operator is a function from DataFrame to DataFrame.  Nothing in here
keeps a corpus on the driver: what is collected is always a small table whose
size is bounded by a parameter or checked before the collect.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
