"""Operators for training-data corpora; the registered queries are in ``llm.queries``."""

import sys

from pyspark import cloudpickle

# Workers get the functions of this package by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
