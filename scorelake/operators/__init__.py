"""DataFrame operators over the note table."""
