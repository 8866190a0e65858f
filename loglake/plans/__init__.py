"""From a query to the files and columns that answer it."""
