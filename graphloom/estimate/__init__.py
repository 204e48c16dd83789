"""Estimates of pattern cardinalities from degree statistics and from sampled walks."""
