"""Canonical column names of the bar panel.

A bar panel has one row per (symbol, date).  ``date`` is a DATE, so one symbol
can own at most 36,525 bars per century: windows per symbol are bounded by the
calendar.  The number of names on one date has no such bound, which is why
per-date work goes through ``operators.ranking`` or map-side aggregates.
"""

SYMBOL = "symbol"
DATE = "date"
BAR = "bar_no"
FACTOR = "factor_id"
VALUE = "value"

OHLCV = ["open", "high", "low", "close", "volume"]
