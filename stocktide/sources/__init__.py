"""Readers and writers."""

from stocktide.sources.landing import *  # noqa: F401,F403
from stocktide.sources.readers import *  # noqa: F401,F403
from stocktide.sources.writers import *  # noqa: F401,F403
