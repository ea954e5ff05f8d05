"""Cleaning of line networks, and operators for training data, on Spark."""

from .plans.clean import clean_file, clean_network, run_deoverlap, run_explode, run_merge_degree2, run_remove_components, run_simplify, run_snap, run_split
from .plans.config import CleanConfig

__all__ = ["CleanConfig", "clean_file", "clean_network", "run_deoverlap", "run_explode", "run_merge_degree2", "run_remove_components", "run_simplify", "run_snap", "run_split"]
