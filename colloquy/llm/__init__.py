"""Training-data operators over the tables documents, pages and labels."""
