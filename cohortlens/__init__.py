"""Analytics operators for PySpark, written as DataFrame plans."""
