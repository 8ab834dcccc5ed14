"""corvane: record ingestion, matching, evaluation and streaming on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
