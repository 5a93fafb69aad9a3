"""Training-data operators: language id, decontamination, tokenising, WARC, URL rules,
toxicity, sharding, quality, substring and near-duplicate removal.

Nothing else in gridloom imports this package.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions and classes travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
