"""Curation and analysis of daily station series as Spark DataFrame operators.

Every operator takes a DataFrame and returns a DataFrame, so chains read as
``df.transform(to_daily).transform(flag_outliers, "gasto_medio_m3s")``.
"""

import sys

from pyspark import cloudpickle

# Functions go to the Python workers by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
