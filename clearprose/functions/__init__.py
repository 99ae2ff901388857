"""Column functions that the operators share."""
