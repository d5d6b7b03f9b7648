from driftwell.sources.tables import table

__all__ = ["table"]
