"""Analytics over catalogues of works, on Spark."""
