"""Reading and writing the tables of transcript studies."""
