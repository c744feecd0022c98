"""Reduces a flood of monitoring alarms to a short, ranked list of incidents, as Spark batch jobs."""
