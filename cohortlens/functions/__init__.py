"""Column expressions (JVM-side, codegen'd): parsing, hashing, text rules."""
