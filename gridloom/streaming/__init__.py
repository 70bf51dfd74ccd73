"""Containers on streams. No state crosses rasters, so the batch operators run on a stream as they are."""
