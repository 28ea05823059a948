"""labloom: a PySpark-native engine for lab-report analytics and the preparation of text corpora.

Everything is a function from DataFrames to a DataFrame. Catalyst plans the work; Python runs only inside
Arrow batches where built-in expressions can't state the semantics.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions sent to executors travel whole, so that executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
