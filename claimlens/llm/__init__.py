"""Training-data operators: filters, deduplication, decontamination and mixing of a text corpus.

Nothing outside this folder imports it. One module per operator, `catalog` registers their queries.
"""
