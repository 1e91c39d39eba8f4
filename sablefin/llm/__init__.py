"""Operators for preparing training text: dedup, archives, scoring, rules, packing.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so a job needs no copy of the repository on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
