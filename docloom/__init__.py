"""Document intelligence at corpus scale, written as PySpark DataFrame transformations."""
