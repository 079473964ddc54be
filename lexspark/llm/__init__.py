"""Training-data operators: one module for each, and queries.py with the registered queries."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
