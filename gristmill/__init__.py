"""gristmill: building, auditing and evaluating typed-decision datasets as Spark plans."""

__version__ = "0.1.0"
