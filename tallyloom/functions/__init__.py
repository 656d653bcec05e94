"""Column expressions: everything here takes and gives ``Column`` and stays in the JVM."""
