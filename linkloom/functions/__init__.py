"""Column functions: normal forms, tokens, codes and similarities of texts."""
