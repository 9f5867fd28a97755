"""qsumm: question-driven summarization data work as Spark DataFrame operators.

Layout
------
functions/  Column -> Column text, url and html helpers (JVM built-ins only)
operators/  DataFrame -> DataFrame operators (joins, grouping, windows, metrics)
sources/    readers for the driver tables and for the file formats of the corpus
plans/      size-checked join helpers and the query catalogue wired to driver tables
streaming/  Structured Streaming jobs over metric and prediction streams
"""

__version__ = "0.1.0"
