"""Training-data operators: deduplication, decontamination, packing, scans, classifiers, fingerprints.

Nothing outside this subpackage imports it.
"""
