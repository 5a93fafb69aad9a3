"""Functions on columns, and the small helpers that run in tasks.

Executors need no copy of this package: what runs in tasks travels with them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
