"""Ticket and complaint-trend analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their helpers along, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
