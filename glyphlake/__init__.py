"""glyphlake: corpus building and measurement as Spark DataFrame transformations."""
