"""stepframe: data-step and procedure semantics as Spark DataFrame operators."""

__version__ = "0.1.0"
