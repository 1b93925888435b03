"""ledgerlake: versioned data, vector search and event analytics as DataFrame operators."""
