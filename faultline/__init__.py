"""faultline: incident analytics over log tables and log streams, as Spark jobs."""

from faultline.session import configure, get_session

__all__ = ["configure", "get_session"]
