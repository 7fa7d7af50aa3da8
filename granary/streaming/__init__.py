"""Structured Streaming over the record log: an extension, since readers of the log poll it."""
