"""Chunk, embed and retrieve record tables as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the serialized function, so executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
