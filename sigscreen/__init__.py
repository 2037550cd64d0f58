"""Feature-signal discovery for multiclass entity classification, on Spark.

Three calls make up the workflow: ``profile`` describes tables and their join
keys, ``build_features`` materialises one row per entity, and ``screen`` judges
each feature against a label.
"""

from sigscreen.plans.build_features import Wiring, build_features
from sigscreen.plans.profile import profile
from sigscreen.plans.screen import rescreen_diff, screen
from sigscreen.operators.verdict import Thresholds

__all__ = ["Thresholds", "Wiring", "build_features", "profile", "rescreen_diff", "screen"]
