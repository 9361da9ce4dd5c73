"""kgspark: knowledge-graph ETL, profiling and lookup as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
