"""docustrata: document evidence and training-data preparation as Spark DataFrame plans."""
