"""Training-data operators: deduplication, classification, tokenisation, packing.

Nothing else in the library imports this subpackage. Each operator module holds
the general interface; ``queries`` registers one thin query per operator.

Task functions are pickled by value, so executors need the installed libraries
but not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
