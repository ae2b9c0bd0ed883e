"""Analytics over clinical conversations, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
