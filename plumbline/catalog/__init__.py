from . import further, history, profiles, relational, table_checks, times, unusual  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
