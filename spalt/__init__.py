"""spalt: relational operators, strict value semantics and corpus operators on PySpark DataFrames."""
