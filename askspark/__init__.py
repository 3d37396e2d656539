"""Question-answering data toolkit on Spark: every operator is a DataFrame function."""
