"""corpusloom: grounded retrieval and corpus processing as Spark plans.

Its functions travel to Python workers by value, so executors need no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
