"""covarium: stratified text-embedding analytics on Spark DataFrames."""
