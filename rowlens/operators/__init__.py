"""Row matching, key and rename detection on DataFrames."""
