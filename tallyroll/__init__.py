"""Receipt extraction analytics on Spark: normalise, parse, validate, match, score."""
