"""Longitudinal (person x wave) panels and causal effects as Spark DataFrame jobs."""
