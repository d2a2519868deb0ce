"""Payment analytics on Spark: point-in-time features, ledgers, graphs, drift, evaluation, quality and streaming."""
