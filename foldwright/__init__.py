"""foldwright: dataset curation and prediction evaluation as Spark DataFrame jobs.

Sub-packages
------------
functions   column expressions (argmax, margin, entropy, paths, vectors)
operators   DataFrame -> DataFrame operators (metrics, noise, dedup, splits, tuning, heads)
sources     file formats in and out (images, CSV contracts, vector sets, submissions)
streaming   resumable ingestion with Structured Streaming
plans       operators chained into the jobs a user runs end to end
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
