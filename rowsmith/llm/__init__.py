"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so a job needs no installed
# copy of the library there, from whatever folder it is started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
