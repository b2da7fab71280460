"""Training-data operators (deduplication, token counting, archives, search, mixing, scoring).

Nothing else in the library imports this subpackage. Python code that runs in tasks is
shipped by value, so executors need only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
