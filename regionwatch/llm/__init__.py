"""Operators for text corpora: scans, token counts, de-duplication, packing and the like."""
