"""Pattern mining, MDL compression and clause reasoning on Spark DataFrames of integer sets."""
