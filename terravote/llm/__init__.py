"""Training-data operators on DataFrames.  Nothing else in the package imports this folder."""
