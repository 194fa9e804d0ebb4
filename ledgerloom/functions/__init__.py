"""Column expressions (JVM-side, no UDFs): statement dates, exact amounts, text clean-up, name similarity."""
