"""Move warehouse tables with Spark and prove that the copy equals the source."""

from datamove.spec import TableMapping

__all__ = ["TableMapping"]
