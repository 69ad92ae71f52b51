"""Column functions: text folding, tokens, identifiers, token estimates."""
