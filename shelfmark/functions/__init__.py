"""Column expressions. All of them are built from JVM-side functions."""
