"""Writers: overwrite, append, keyed append (first write wins), JDBC."""

from navframe.sinks.table import Table, keyed_table
from navframe.sinks.writers import append, append_new, overwrite, write_jdbc

__all__ = ["Table", "append", "append_new", "keyed_table", "overwrite", "write_jdbc"]
