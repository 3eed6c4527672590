"""Reading and writing feeds, and the feeds derived from other tables."""
