"""Spindle: a semantic query layer and corpus toolkit expressed as Spark DataFrame plans."""
