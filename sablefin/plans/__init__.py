"""Query trees, their text form, and their compilation to DataFrames of hits."""
