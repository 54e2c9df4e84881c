"""Named queries over the tables of a folder, each with its SQL where SQL can express it."""
