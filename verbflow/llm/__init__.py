"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin registered queries.
"""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: what tasks use of it travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
