"""Cohort-scale analytics of sampled spatial data, written as Spark DataFrame transformations."""
