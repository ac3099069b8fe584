from .sql import ORACLE

__all__ = ["ORACLE"]
