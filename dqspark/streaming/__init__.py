"""Row-wise steps on streaming DataFrames."""
