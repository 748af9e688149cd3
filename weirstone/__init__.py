"""weirstone: a PySpark-native engine for curating and searching document corpora.

The core (sources, functions, operators, plans, streaming, queries) never imports the
subpackage ``llm``; that one holds the training-data operators and can be deleted.
"""
