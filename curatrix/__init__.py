"""curatrix: relationship-table curation and evaluation on Spark DataFrames."""
