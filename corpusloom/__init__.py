"""PySpark jobs over scholarly feeds, and operators for text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
