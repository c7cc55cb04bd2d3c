"""Set operators Spark has no single call for: keyed merge, quarantine split, threshold match."""
