"""Point and track analytics on Spark DataFrames."""

from .columns import Columns
from .session import configure, get_session

__all__ = ["Columns", "configure", "get_session"]
