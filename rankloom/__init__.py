"""Site-audit and search-analytics jobs written as PySpark DataFrame code."""
