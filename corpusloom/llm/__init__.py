"""Training-data operators: sharding, dedup, classifiers, packing, search, codecs.

Nothing outside this subpackage imports it. Its functions travel to Python workers by value, so executors need the
libraries it uses but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
