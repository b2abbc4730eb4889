"""State of a derived table: numbered manifests in its folder, of which the last holds."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources import files


class Manifest:
    """A commit writes the next number; of two writers the second fails, and nothing is seen half done."""

    def __init__(self, spark: SparkSession, path: str, first: dict):
        self.spark, self.path, self.first = spark, f"{path.rstrip('/')}/_manifests", first

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.children(self.spark, self.path) if n.endswith(".json"))

    def read(self) -> tuple[int, dict]:
        """(number, state); 0 and the first state if nothing was committed."""
        numbers = self._numbers()
        return (numbers[-1], json.loads(files.read_text(self.spark, f"{self.path}/{numbers[-1]:012d}.json"))) if numbers else (0, dict(self.first))

    def commit(self, number: int, state: dict, keep: int = 20) -> None:
        """Makes the state the one after number; older manifests go, but for the last few, which readers may hold."""
        files.write_new(self.spark, f"{self.path}/{number + 1:012d}.json", json.dumps(state))
        for n in self._numbers()[:-keep]:
            files.delete(self.spark, f"{self.path}/{n:012d}.json")

    def update(self, change: Callable[[dict], dict | None], tries: int = 200) -> dict:
        """Commits change(state), anew on the state of whoever was first; None leaves all as it is. The state that holds then."""
        for _ in range(tries):
            try:
                number, state = self.read()
                after = change(json.loads(json.dumps(state)))
                if after is None:
                    return state
                self.commit(number, after)
                return after
            except FileExistsError:
                time.sleep(random.random() * 0.05)
        raise TimeoutError(f"{self.path}: too many writers")
