"""Media-record curation engine on PySpark DataFrames."""
