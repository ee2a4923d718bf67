"""cityportrait: building-scale synthetic populations on Spark DataFrames."""
