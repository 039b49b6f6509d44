"""Measure, on real tables and at scale, the mistakes that let a valid query return a wrong number."""
