"""Climate-impact and adaptation analytics as plain PySpark DataFrame operators."""
