"""DataFrame -> DataFrame operators: numbering and batching, splits, relabelling, joins,
top-1 per group, metrics, generators, the centroid model and vectorised scoring."""
