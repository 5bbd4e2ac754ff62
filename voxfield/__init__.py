"""Voxel-field analytics on Spark: every operator is a function from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
