"""marginalia: reading-taste analytics and catalogue enrichment on Spark DataFrames."""
