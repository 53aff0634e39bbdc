"""Tables: versioned storage, locks, constraints."""
