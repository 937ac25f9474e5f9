"""Operators for preparing training text at large scale.

One module per operator, each with its own general interface; ``queries``
holds the registered queries and their SQL. Nothing outside this subpackage
imports it, apart from the guarded registration in ``__spark_entry__.py``.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: a cluster needs
# no installed copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
