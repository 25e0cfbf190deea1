"""Order-message analytics on Spark.

The package is pickled by value into Python tasks, so executors need nothing
but PySpark, pyarrow, pandas and numpy: no copy of this package has to be
installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
