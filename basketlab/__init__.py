"""Portfolio screening and measurement as Spark DataFrame jobs."""

from basketlab.params import DAILY, WEEKLY_BARS, Params

__all__ = ["DAILY", "WEEKLY_BARS", "Params"]
