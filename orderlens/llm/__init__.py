"""Training-data pipeline operators; nothing else in the package imports this folder.

Functions that run inside tasks travel to the executors by value, so a cluster needs
the libraries they use, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
