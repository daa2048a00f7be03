"""A strict, string-typed relational engine and data-processing toolkit on PySpark."""
