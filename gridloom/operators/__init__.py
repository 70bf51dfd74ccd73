"""Array operators as DataFrame expressions over pixel relations (raster_id, band, row, col, depth, value, valid)."""
