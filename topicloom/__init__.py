"""topicloom: topic clustering, topic keywords and vector search as Spark jobs.

Every public operator takes and returns DataFrames.  Arrow kernels defined in
this package travel to the executors by value, so a cluster needs no extra
installation step beyond numpy and pyarrow next to PySpark.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
