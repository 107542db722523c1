"""Uplift modelling and experiment analytics on Spark DataFrames.

All operators take and return lazy DataFrames; columns with a role are named once, in an Experiment.
"""

from deltaplane.operators.evaluate import Bootstrap, cate, cate_lift, cum_iroi, iroi, qini, roi, target_rate
from deltaplane.operators.roles import Experiment

__all__ = ["Bootstrap", "Experiment", "cate", "cate_lift", "cum_iroi", "iroi", "qini", "roi", "target_rate"]
