"""Training-data operators on Spark.

Nothing else in the package imports this subpackage; it can be deleted as a
whole. Operators take DataFrames and name their own output columns, so extra
columns of the input, whatever they are called, never clash.
"""
