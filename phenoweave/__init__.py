"""phenoweave: cohort phenotyping on Spark DataFrames.

Wide all-string observational exports go in; cleaned long tables, descriptive
statistics, sparse person x feature matrices, clusterings, quality scores and
cluster profiles come out, all as DataFrames.
"""

from phenoweave.session import build_session

__all__ = ["build_session"]
