"""Files in and out: packs of the record log, CSV, JSON, HTML and SQL scripts."""
