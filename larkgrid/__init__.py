"""larkgrid: best-record grid queries over transaction tables, as declarative Spark plans."""

__version__ = "0.1.0"
