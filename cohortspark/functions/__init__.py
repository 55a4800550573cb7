"""Column builders; every function takes and returns ``Column`` and runs in the JVM."""
