"""Tidemark: drift analytics of multivariate streams, and corpus preparation, on Spark.

Functions that run on executors are sent with their code, so executors need not have this package.
"""

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

_by_value(_sys.modules[__name__])
