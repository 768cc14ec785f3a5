"""pathloom: a PySpark engine for planning, authorising and evaluating concurrent change sets.

Everything is a DataFrame in, DataFrame out.  Catalyst plans the relational work; the few
operators that iterate cut their lineage through tables in the shared checkpoint folder.
"""

__version__ = "0.1.0"
