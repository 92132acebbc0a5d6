"""tidemark: a Spark-native payments analytics engine."""

from tidemark.session import build_session

__all__ = ["build_session"]
