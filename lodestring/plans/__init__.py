"""Planning: which strategy answers a query, and where tables are kept."""
