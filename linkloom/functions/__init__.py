"""Column functions: no UDFs, everything stays inside JVM expressions."""
