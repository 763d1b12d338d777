"""Whole plans: build an index, map reads, sample and verify."""
