"""Operators for preparing training corpora: one module per operator, plus the
registered queries (``catalog``) and their SQL (``oracle``).  Nothing outside
this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
