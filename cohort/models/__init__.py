"""Classifiers on ``pyspark.ml``: fitting, evaluation, screening, tuning, model-based fills."""

import sys

from pyspark import cloudpickle

from .classify import Fitted, analyze, fit, importance, kmeans_1d
from .fill import fill_by_model
from .forest import oob_error, oob_votes, permuted_importance, tune_mtry
from .metrics import binary_metrics, chi2_screen, confusion
from .search import cross_validate, forward_select, run_grid, screen_columns, tune

# what runs in the tasks travels by value: executors need numpy, pandas and pyarrow, but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [n for n in dir() if not n.startswith("_")]
