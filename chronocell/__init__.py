"""A PySpark engine for tagged time-series cut into power-of-two cells."""
