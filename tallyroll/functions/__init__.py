"""Column -> Column functions and the one Arrow UDF family."""
