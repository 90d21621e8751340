"""Operations of a training-data pipeline: text, vectors and conversations at corpus scale.

Each module holds one operator with its general interface. ``queries`` registers a thin query per operator.
"""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
