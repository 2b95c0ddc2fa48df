"""talus: a Spark-native engine for point clouds, rasters, graphs and hierarchies.

Every public operation takes and returns lazy DataFrames.  Rows carry explicit
ids, because Spark rows have no position.
"""
