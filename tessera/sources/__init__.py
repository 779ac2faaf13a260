"""Sources and sinks: files, Git, JSON graphs, generations, vectors, caches."""
