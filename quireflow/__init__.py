"""Document analytics on Spark: files of page-description syntax become relational tables.

Sub-packages: ``functions`` (lexing, decoding, scalar parsers), ``sources`` (readers),
``operators`` (DataFrame transformations), ``plans`` (named queries with their SQL),
``streaming`` (incremental ingestion). ``llm`` is optional and imported by nothing here.
"""

__version__ = "0.1.0"
