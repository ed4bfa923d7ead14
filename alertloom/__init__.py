"""Alert correlation on Spark: unify, collapse, label, pair, reconstruct, measure."""
