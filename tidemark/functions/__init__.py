"""Part of the time-series library."""
