"""tidemill: labelled multivariate time-series analytics as Spark DataFrame operators."""

from tidemill.schema import Columns

__all__ = ["Columns"]
