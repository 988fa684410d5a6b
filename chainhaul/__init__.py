"""chainhaul: movement analytics of commercial vehicles on Spark DataFrames."""
