"""Named queries: operators bound to the tables, each with its SQL twin."""
