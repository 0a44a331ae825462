"""tidepanel: preparation and feature selection for panels of time series on Spark.

The canonical table is long: ``panel(panel_id, series_id, ts, value)`` with one
row per panel, series and date.
"""

import sys

from pyspark import cloudpickle

# Small numpy helpers travel inside the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
