"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are shipped by value, so executors need neither this package
on their path nor a shared installation folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
