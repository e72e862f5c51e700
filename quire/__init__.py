"""quire: document-corpus analytics on PySpark."""
