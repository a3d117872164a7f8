"""Training-data operators. Nothing outside this package and the query registry imports it."""
