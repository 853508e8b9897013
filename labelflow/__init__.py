"""labelflow: Spark-native data work around text labelling.

Every operator is a function from DataFrame(s) to DataFrame built on Spark
expressions, joins, windows and aggregates.  Python runs inside tasks only
where no native expression exists (stdlib difflib, BLAS top-n, pluggable
scorers), always on Arrow batches.
"""

__version__ = "0.1.0"

# Functions shipped to Python workers (Arrow UDF bodies and the helpers they
# call) are pickled by value, so executors never need this package on their
# path, whatever folder the driver runs from.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
