"""A geospatial analytics engine on PySpark DataFrames."""
