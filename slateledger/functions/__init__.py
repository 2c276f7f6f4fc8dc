"""Column functions: grammars, normalisers and rules."""
