"""voltlake: multichannel biosignal analytics on Spark DataFrames."""
