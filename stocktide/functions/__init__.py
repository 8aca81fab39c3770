"""Scalar and aggregate expressions shared by the operators."""

from stocktide.functions.dates import *  # noqa: F401,F403
from stocktide.functions.numeric import *  # noqa: F401,F403
from stocktide.functions.text import *  # noqa: F401,F403
