"""granary: a PySpark-native analytics engine with a MySQL-flavoured dialect, rules and a replayable record log."""
