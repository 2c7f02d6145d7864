"""Spark-native order-operations and late-delivery analytics.

Every public function takes and returns Spark DataFrames; nothing here pulls
data rows to the driver except the named checks in ``functions.contracts``
and the small boundary look-ups in ``functions.selection``.
"""

from orderlens.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
