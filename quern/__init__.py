"""Feature, quality, scoring and blending operators as PySpark DataFrame functions."""
