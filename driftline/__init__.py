"""driftline: Spark-native data and model monitoring operators.

Every operator is a function ``fn(df, ..., *, keys=()) -> DataFrame`` built from
DataFrame / SQL expressions so Catalyst plans it and executors do the work.
Sub-packages:

* ``sources``   scans and sinks (CSV, Parquet, NDJSON logs, threshold tables)
* ``functions`` column-expression helpers shared by the operators
* ``operators`` cleaning, validation, profiling, ordering, metrics, drift, SLOs
* ``plans``     named end-to-end plans over the test tables (the query catalogue)
* ``streaming`` Structured Streaming variants of the log / alert operators
"""

__version__ = "0.1.0"
