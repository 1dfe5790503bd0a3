"""fathom: retrieval, evidence checking and data processing over source text, as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the tasks, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
