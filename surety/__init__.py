"""Calibration, uncertainty and trust analytics for anomaly-score tables on Spark."""
