"""Volumetric cohort analytics on Spark: labelled 3-D grids as DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks are shipped with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
