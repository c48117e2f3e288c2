"""Parameters of the ratings analytics jobs.

The values below are fixed values that must equal the studied workflow for
results to match; every job takes them as keyword arguments so callers can
change them.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values (must match the studied workflow) -------------------------
# Confidence thresholds swept by the evaluation: 70, 75, 80, 85, 90, 95, 100.
THRESHOLD_START = 70
THRESHOLD_STOP = 100
THRESHOLD_STEP = 5
THRESHOLDS = tuple(range(THRESHOLD_START, THRESHOLD_STOP + 1, THRESHOLD_STEP))
# Thresholds reported in the "selected" welfare summary.
SELECTED_THRESHOLDS = (100, 95, 85, 80)
# Extreme annotator: more than EXTREME_CUT percent of ratings more than
# EXTREME_GAP below (or above) the text mean.
EXTREME_GAP = 0.5
EXTREME_CUT = 50.0
# Minimum ratings per annotator in train and in test.
MIN_TRAIN = 12
MIN_TEST = 6
# Share of texts that go to the test split.
TEST_FRACTION = 0.2
# Number of random split trials in the best-split search.
N_SPLIT_TRIALS = 100
# Share of predictions above which an annotator counts as "overridden" (rule pct).
OVERRIDE_SHARE = 0.05
# Label maps of the external benchmark.
GOLD_LABEL_MAP = {"hateful": 1, "non-hateful": 0}
BOUNDARY_CLASS_MAP = {"1": 1, "yes": 1, "no": 0}
# Seeded order for reproducible random choices: ORDER_DIGITS hex digits, an
# integer below ORDER_RANGE. A SHA-256 digest of (id, seed div ORDER_KEYS) holds
# the keys of ORDER_KEYS seeds.
ORDER_DIGITS = 13
ORDER_KEYS = 4
ORDER_RANGE = 16 ** ORDER_DIGITS
# -----------------------------------------------------------------------------

# Group names used by every per-group evaluation.
GROUP_ALL = "all"
GROUP_EXTREME = "extreme"
GROUP_NON_EXTREME = "non_extreme"


@dataclass(frozen=True)
class DatasetSpec:
    """Column mapping of a ratings table (the two layouts differ in names)."""

    text: str = "comment"
    text_id: str = "text_id"
    rater: str = "worker_id"
    annotator_id: str = "annotator_id"
    score: str = "toxic_score"


COMMENT_LAYOUT = DatasetSpec()
SECOND_LAYOUT = DatasetSpec(text="text", rater="annotator_id")
