"""Named queries over a folder of tables, with equivalent SQL where SQL can express them."""
