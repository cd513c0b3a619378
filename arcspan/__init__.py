"""arcspan: point-pattern, corridor and training-data operators on Spark DataFrames."""
