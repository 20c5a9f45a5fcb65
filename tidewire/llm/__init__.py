"""Training-data operators: filtering, deduplication, mixing, packing and formatting of text corpora.

Nothing outside this subpackage imports it. Each module holds one operator with its general interface;
``queries`` holds the registered ``opN_<name>`` queries and their SQL.
"""
