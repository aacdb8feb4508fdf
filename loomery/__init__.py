"""loomery: code and document analytics as PySpark DataFrame plans."""
