"""Column expressions and the JSON functions behind the Arrow UDFs."""
