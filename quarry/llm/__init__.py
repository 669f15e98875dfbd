"""Training-data operators: language ID, URL filters, near-duplicate joins, fingerprints, token files,
passage repeats, decontamination, secret scans, packing, sharding, filter audits, source mixing and vector codes.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin contract queries, ``oracles.py`` their SQL.
"""
