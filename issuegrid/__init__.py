"""issuegrid — set-based analytics for work-tracking data on Apache Spark.

Subpackages: ``sources`` (scans, writers, stand-in tables), ``functions`` (column
expressions for display and clean-up), ``operators`` (joins, reports, paging,
documents, validation, changes, visibility), ``streaming`` (running roll-ups) and
``plans`` (the registered queries and their SQL oracles).
"""

__version__ = "0.1.0"
