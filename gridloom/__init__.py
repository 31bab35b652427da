"""gridloom: raster files and large text corpora as Spark DataFrames."""
