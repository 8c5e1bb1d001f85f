"""lettera: a Spark-native engine for digitised historical text.

The package's functions are shipped to executors by value, so a cluster needs
no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
