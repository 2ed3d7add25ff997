"""Training-data operators: joins, scans, filters, formats and encodings over text tables."""
