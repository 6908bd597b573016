"""The operators exercised over the star-schema test tables, with SQL equivalents."""
