"""donorlens: donor-propensity analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    table loaders, donation-schema views over the raw tables, CSV sink
functions  column helpers that reproduce R/dplyr null semantics
operators  generic building blocks (profiles, pivot, split, metrics, SMOTE, ...)
plans      the reference workflow: profiling, donor features, program
           datasets, propensity models
"""

from donorlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: a cluster needs
# no installed copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
