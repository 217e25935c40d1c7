"""siftwell: training-data selection and preparation on PySpark DataFrames."""
