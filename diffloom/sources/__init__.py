"""Landing-file readers and result-table writers."""
