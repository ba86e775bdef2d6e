"""Column functions: decoding, geodesy, polylines, predicates."""
