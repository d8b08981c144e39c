"""A PySpark engine for ordered, integer-keyed, versioned data, and operators for training-data pipelines."""
