"""Incremental forms of the corpus builders."""
