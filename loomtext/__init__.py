"""loomtext: text-corpus analytics as Spark DataFrame operators."""
