"""Repository-graph analytics as Spark jobs: every public function takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers carry their code with them, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
