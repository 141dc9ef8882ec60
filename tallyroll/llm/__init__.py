"""Operators that prepare a training corpus: packing, filters, dedupe, privacy, quality."""
