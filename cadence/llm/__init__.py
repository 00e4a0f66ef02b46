"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it (``__spark_entry__`` adds its
queries only when it is there); it borrows general helpers from the rest of
the library. Each module holds one operator with its own general interface;
``queries`` derives the registered ``opN_*`` results from them.
"""
