"""folia: document-element analytics on PySpark.

A document is a flat, depth-first sequence of typed elements whose tree is
implied by depth and adjacency. ``functions`` are Column expressions over the
list form (one document a row), ``operators`` are DataFrame transformations
over the row form (one element a row), ``sources`` read and write.
"""
