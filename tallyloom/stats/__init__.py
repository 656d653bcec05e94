"""Statistics: Spark reduces rows to small sufficient tables; closed forms follow, as columns where elementary."""
