"""Column -> Column expressions. All run inside the JVM (no Python UDFs)."""
