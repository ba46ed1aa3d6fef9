"""Spark-native episodic catalogue building, gated retrieval and evaluation."""

from episodika.operators.gate import ALL_EPISODES, visible

__all__ = ["ALL_EPISODES", "visible"]
