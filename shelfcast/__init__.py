"""shelfcast: retail-demand analytics on Spark DataFrames."""
