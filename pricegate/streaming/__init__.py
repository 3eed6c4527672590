"""The row contract and revisions on streams."""
