"""stayflow: customer segmentation and churn-risk analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions are shipped by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
