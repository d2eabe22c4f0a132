"""Named queries over the test tables, and the SQL that they must agree with."""
