"""Lakes of tables, their cell index, readers and writers."""
