"""Analytics over code-review runs, as Spark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

from reviewlake.session import configure

# The few Python functions that run inside tasks travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure"]
