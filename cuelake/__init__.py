"""Timed-text analytics on Spark: transcripts, cues, dictionaries, reviews and event logs as DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
