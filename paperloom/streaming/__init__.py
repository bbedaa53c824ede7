"""Event-time operators that run on batch and streaming DataFrames alike (an extension: the operators elsewhere are batch)."""
