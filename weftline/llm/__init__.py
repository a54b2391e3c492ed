"""Training-data operators: scans, dedup, packing, search, classifiers, mixing.

Nothing outside this subpackage imports it; its queries are registered by the
entry module only when the subpackage can be imported.
"""
