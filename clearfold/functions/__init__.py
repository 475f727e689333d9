"""Column functions: every one returns an expression that stays inside the JVM."""
