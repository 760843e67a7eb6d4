"""Extension: the ledger as a stream."""
