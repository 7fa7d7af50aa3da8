"""A MySQL-flavoured dialect, translated to Spark SQL."""
