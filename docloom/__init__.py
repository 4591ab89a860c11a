"""docloom: document analytics as PySpark DataFrame transformations."""
