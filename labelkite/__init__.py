"""labelkite: packaged-goods label analytics as PySpark DataFrame plans."""
