"""docflow: document ingestion, retrieval, chat history and SQL jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task closures travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
