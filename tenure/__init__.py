"""tenure: subscription-retention analytics as Spark DataFrame jobs.

Members, subscription transactions, daily usage logs and churn labels go in;
per-user feature rows, churn-rate reports, time-series diagnostics and
classifier scores come out.  Every operator is a function from DataFrames
(plus plain parameters) to a DataFrame, so Catalyst sees one plan per query.
"""

__version__ = "0.1.0"
