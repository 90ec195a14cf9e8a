"""Where the catalog reads from and writes to."""
