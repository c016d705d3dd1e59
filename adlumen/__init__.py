"""adlumen: ad-performance analytics as Spark DataFrame functions.

Everything here maps DataFrames to DataFrames (or Columns to Columns).  The
work is left to Catalyst; the driver only ever sees parameters whose size is
bounded by the number of columns, models or explicitly checked vocabularies.
"""
