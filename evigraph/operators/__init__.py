"""Graph, series, search, extraction and write-path operators over DataFrames."""
