"""panelcast — sales analytics and forecasting over many series, on Spark.

Every function takes and returns DataFrames, so steps chain with
``DataFrame.transform``. A *panel* is a table of periods keyed by
``keys`` (zero or more series columns) and ordered by ``date`` (then
``seq`` when present); one series is the case ``keys=[]``.
"""

__version__ = "0.1.0"
