"""Scalar functions: coercions, names, addresses, encodings, markup."""
