"""Operators of a training-data pipeline: sharding, filtering, deduplication, decontamination, tokenising, packing, models."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with their tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
