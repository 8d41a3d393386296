"""Training-data operators: archives, fingerprints, mixing, filters, packing, search, language models, joins, coding, chat.

Nothing outside this subpackage imports it. Every module holds one operator with
a general interface; ``queries.py`` applies each to its whole table.
"""
