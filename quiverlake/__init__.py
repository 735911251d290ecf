"""quiverlake: vector search and data processing on PySpark."""

import sys

from pyspark import cloudpickle

#: Functions sent to executors carry the package's code with them, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
