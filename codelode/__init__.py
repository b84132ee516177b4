"""Code and document search on Spark: scan, chunk, analyze, embed, store, search."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors inside their tasks, so the
# package need not be installed on the cluster's workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
