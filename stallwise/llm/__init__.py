"""Operators of a training-data pipeline."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tasks get these functions with the job: executors need not have the package installed.
register_pickle_by_value(sys.modules[__name__])
