"""Public-transport demand analytics expressed as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions that run in Python tasks travel with the job, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
