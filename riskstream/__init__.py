"""riskstream: payment-fraud analytics as Spark DataFrame operators.

Every operator takes DataFrames (and Columns) and returns DataFrames; the
same definitions serve batch tables and Structured Streaming.
"""

__version__ = "0.1.0"
