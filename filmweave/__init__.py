"""Analytics over an encyclopedia dump: pages to a network of people and works, in PySpark."""
