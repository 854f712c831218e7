"""Log and file ingestion, profiling and event analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from logloom.session import build_session

# Functions sent to Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
