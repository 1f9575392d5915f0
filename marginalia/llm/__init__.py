"""Operators of a training-data pipeline.

Functions of this subpackage that run inside tasks travel by value, so a
cluster's executors need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
