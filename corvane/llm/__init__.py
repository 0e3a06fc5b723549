"""Training-data operators: one module each, with thin contract queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules["corvane"])
