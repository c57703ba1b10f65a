"""Spark jobs for exploring large collections of free-text records.

Every public function takes DataFrames and returns lazy DataFrames (iterative
jobs cut their lineage with checkpoints on the way). See README.md.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task: executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
