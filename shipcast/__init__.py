"""shipcast: delivery-risk and logistics-decision analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function whose core work
runs as Spark jobs (joins, grouping, windows).  Operators live in
``shipcast.operators``; data access in ``shipcast.sources``; reusable column
expressions and distributed helpers in ``shipcast.functions``; the registered
query plans (Spark + DuckDB oracle) in ``shipcast.plans``.
"""

__version__ = "0.1.0"
