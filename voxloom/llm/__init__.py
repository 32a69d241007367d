"""Operators of a training-data pipeline over documents.

Nothing else in the library imports this subpackage. Its functions travel inside
the task, as the rest of the package does, so workers need no copy of it.
"""

from pyspark import cloudpickle

import voxloom

cloudpickle.register_pickle_by_value(voxloom)
