"""The live path: Structured Streaming forms of the operators."""
