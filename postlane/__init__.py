"""postlane: DataFrame operators over a mail corpus, from raw exports to reports and training text."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
