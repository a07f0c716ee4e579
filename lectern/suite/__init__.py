from lectern.suite import catalogue, composed, decks, files, memory, playback, slides, timed_text  # noqa: F401
from lectern.suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
