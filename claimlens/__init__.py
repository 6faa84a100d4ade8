"""claimlens: claim monitoring and coordination analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the task: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
