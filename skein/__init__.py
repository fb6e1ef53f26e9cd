"""skein: execution-trace analytics and training-data operators on Spark DataFrames."""
