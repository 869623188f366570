"""Spark-native anomaly analytics for log event traces and network flows."""

import sys

from pyspark import cloudpickle

from tracewarden.session import build_session, materialize

# functions of this package travel with their tasks, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialize"]
