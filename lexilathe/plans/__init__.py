"""Named queries over the tables, each with its SQL form where SQL can express it."""
