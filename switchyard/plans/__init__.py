"""Sessions, scratch tables and registered query plans."""
