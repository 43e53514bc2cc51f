"""Document analytics on PySpark: DataFrame and Column functions for cleaning, chunking, relating and searching text."""
