"""Training-data operators: packing, scoring, formatting, near-dedup, search, counting and record files.

Nothing else in the library imports this subpackage.  Text heavy operators read
Arrow batches and work on whole byte buffers with numpy; everything that crosses
documents (grouping, joining, ranking) is a DataFrame plan.
"""
