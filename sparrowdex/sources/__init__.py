"""Readers: directories, archives, class files, sources, manifests."""
