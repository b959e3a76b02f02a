"""Training-data operators: each module is one operator over DataFrames, each independent of the warehouse jobs."""
