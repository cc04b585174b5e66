"""PySpark-native engine for tandem-mass-spectrum library search."""

__version__ = "0.1.0"

from .config import SearchSettings, TrainingSettings  # noqa: E402, F401
from .operators.library import Library  # noqa: E402, F401
from .operators.search import analog_search  # noqa: E402, F401
from .sources.loader import load_spectra  # noqa: E402, F401
