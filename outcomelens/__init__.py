"""outcomelens: outcome analytics as Spark DataFrame operators.

Records (one row per participant per batch) are cleaned, encoded, reported on,
learned from and scored with the DataFrame / SQL API so Catalyst plans the work.
Python runs inside tasks only where a fitted network is evaluated (Arrow batches).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
