"""From a statement's text to a DataFrame: the engine with its tables, rules and log."""
