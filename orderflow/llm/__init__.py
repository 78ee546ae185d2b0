"""Training-data operators: deduplication, tokenisation, mixing, language identification, secrets, search.

Task code of this subpackage travels to executors by value, so a cluster needs only the Python libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
