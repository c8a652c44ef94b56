"""Thin queries over the test tables: one for each operator, with the SQL that checks it."""
