"""Whole plans: inventory build, outcome application, snapshot."""
