"""Raw station files, tables, and the synthetic station."""
