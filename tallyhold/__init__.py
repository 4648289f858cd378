"""Archive inventory analytics on Spark DataFrames.

Inventories (listings of a store), manifests and history branches are DataFrames;
comparison, projection and deduplication are joins, aggregations and rankings over them.
"""
