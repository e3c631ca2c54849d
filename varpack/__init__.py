"""varpack: management variance reporting on Spark.

General-ledger postings and a plan in; management P&L, variances, F/U,
materiality, roll-ups, findings and commentary out - for every entity and
period in one job, with DataFrames and native column functions.
"""

from .functions.measures import Materiality  # noqa: F401
