"""capforge: capacity-forecasting data jobs as Spark DataFrame operators.

The main entry points, re-exported here; everything else lives in the submodules
(``capforge.operators.*``, ``capforge.sources.*``, ``capforge.plans.*``).
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are shipped by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"

from capforge.operators.joins import gap_join, gap_report  # noqa: E402
from capforge.operators.metrics import auc, classification_metrics, regression_metrics  # noqa: E402
from capforge.operators.profile import correlation_matrix, dataset_statistics, target_correlation  # noqa: E402
from capforge.operators.ranking import dropped_features, page, preview, select_top_features  # noqa: E402
from capforge.operators.windows import engineer_features  # noqa: E402
from capforge.session import get_session  # noqa: E402
from capforge.sources.files import scan_csv, scan_table, sink_csv, sink_table  # noqa: E402

__all__ = [
    "auc", "classification_metrics", "correlation_matrix", "dataset_statistics", "dropped_features",
    "engineer_features", "gap_join", "gap_report", "get_session", "page", "preview", "regression_metrics",
    "scan_csv", "scan_table", "select_top_features", "sink_csv", "sink_table", "target_correlation",
]
