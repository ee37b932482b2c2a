"""Table storage."""
