"""Operators of a training-data pipeline.

Nothing else in the library imports this package.  Functions that run on executors are
pickled with their code, so executors need neither this package nor the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
