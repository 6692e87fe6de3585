"""Operators for preparing training text, with their queries.

Nothing else in the library imports this package. Its Python functions are sent to executors
by value, so that executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
