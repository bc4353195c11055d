"""Training-data operators: decontamination, mixing, media columns, HTML
extraction, near-duplicates, URL filters, token counts, licence scans, toxicity
and WARC archives.  Nothing else in the library imports this subpackage."""
