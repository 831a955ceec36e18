"""Column expressions: text normalisation, scores and array helpers. All run in the JVM."""
