"""voxloom: mining user feedback into requirements with Spark DataFrames.

Every operator is a function from DataFrame to DataFrame. Column names are
parameters; nothing is collected except tables whose size is fixed by a
parameter (cluster centres, small Gram matrices, stop tests).
"""
