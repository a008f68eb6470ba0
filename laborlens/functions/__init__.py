"""Column functions over text and numbers of postings."""
