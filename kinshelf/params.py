"""Parameters of the model and of the service rules, with their default values."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the service being matched for results to agree.
TITLE_MAX_LENGTH = 500
MIN_LIMIT = 1
MAX_LIMIT = 100
MAX_LIMIT_SIMPLE = 50
DEFAULT_LIMIT = 10
DEFAULT_THRESHOLD = 0.1
RATE_LIMIT_PER_MINUTE = 100
RATE_WINDOW_SECONDS = 60
SNAPSHOT_TTL_HOURS = 24
REQUEST_HISTORY = 10_000
DISPLAY_DESCRIPTION_LENGTH = 300
SEARCH_DESCRIPTION_LENGTH = 200
CPU_ALERT, MEMORY_ALERT, DISK_ALERT = 80, 85, 90

# Sizes of what a job may broadcast. A larger input is worked off in several passes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 8_000_000


@dataclass(frozen=True)
class ModelParams:
    """TF-IDF parameters.

    Descriptions enter the model whole. ``max_features`` is the size of the top-k vocabulary;
    ``stop_words`` of ``None`` takes Spark's own English list.
    """

    # The defaults must equal the service being matched.
    max_features: int = 5000
    min_df: int = 3
    max_df: float = 0.7
    ngram_max: int = 2
    stop_words: tuple[str, ...] | None = None


DEFAULT_MODEL = ModelParams()
