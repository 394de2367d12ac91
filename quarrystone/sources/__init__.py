"""Tables, catalogs, text files."""
