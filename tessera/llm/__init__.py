"""Training-data operators: sharding, license scans, token counts, chat
formatting, language identification, BPE, fingerprints, quality, near-duplicate
detection and benchmark decontamination, mixing, filter audit and conversation repair.

Nothing else in the library imports this subpackage.
"""
