"""linkloom: linking documents across two text corpora as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions run inside tasks travel with the job, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
