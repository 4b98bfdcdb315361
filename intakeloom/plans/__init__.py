"""Whole plans: the intake job, views over the given tables, registered queries."""
