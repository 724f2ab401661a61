"""Operators for building training data: scans, deduplication, decontamination, scoring, mixing, sharding and token files."""

import sys

from pyspark import cloudpickle

# The code of this subpackage travels with the tasks, so executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
