"""Reusable distributed plans: ranking, joins, resampling."""
