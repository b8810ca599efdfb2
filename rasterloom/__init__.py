"""Raster analytics on Spark: image lines as tables, image work as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no copy of this
# package (only numpy and pyarrow).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
