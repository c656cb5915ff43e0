"""Training-data operators.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to executors whole, so that those need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
