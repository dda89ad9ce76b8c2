"""Reading and writing tables, reports, flag tables and rules."""
