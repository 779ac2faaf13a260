"""DataFrame operators over files, chunks, graphs, vectors, indexes and runs."""
