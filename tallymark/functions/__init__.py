"""Column-level building blocks: hashes, bit extraction, estimators, errors, labels."""
