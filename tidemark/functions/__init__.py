"""Column expressions of the lead domain; all built-in, none a UDF, unless the module says so."""
