"""Operators of a pipeline that prepares training text; nothing else in the library imports this package.

Functions that run inside tasks travel with the job, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
