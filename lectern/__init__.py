"""lectern: document structuring, speech text and training-data operators on Spark DataFrames."""
