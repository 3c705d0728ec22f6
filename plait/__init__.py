"""plait: multi-way relational joins, statistics and access paths on Spark DataFrames."""
