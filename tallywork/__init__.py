"""Table cleaning and statistics on Spark: functions from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

from tallywork.errors import Refusal

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Refusal"]
