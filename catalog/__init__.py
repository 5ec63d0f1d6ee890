"""Queries over the test tables, one or more per operator, each with SQL that gives the same rows."""
