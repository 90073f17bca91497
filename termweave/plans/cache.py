"""Loaded vocabularies and their surface dimensions, kept while they are in use."""

from __future__ import annotations

import os
from collections import OrderedDict
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from termweave.operators.match import surface_dimension
from termweave.sources import vocabulary as V


class VocabularyCache:
    """The last `size` documents (by path, time and size of the file) and dimensions (by fingerprint)."""

    def __init__(self, size: int = 16):
        self.size, self.lock = size, RLock()
        self.documents: OrderedDict = OrderedDict()
        self.dimensions: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def _get(self, store: OrderedDict, key, make, drop=lambda x: None):
        with self.lock:
            if key in store:
                self.hits += 1
                store.move_to_end(key)
                return store[key]
            self.misses += 1
            store[key] = made = make()
            while len(store) > self.size:
                drop(store.popitem(last=False)[1])
            return made

    def load(self, spark: SparkSession, path: str) -> V.Vocabulary:
        s = os.stat(path)
        return self._get(self.documents, (os.path.abspath(path), s.st_mtime_ns, s.st_size), lambda: V.load(spark, path))

    def surfaces(self, v: V.Vocabulary, include_deprecated: bool = True) -> DataFrame:
        """The dimension, cached in the executors' memory until it is the oldest."""
        return self._get(self.dimensions, (v.fingerprint, include_deprecated), lambda: surface_dimension(v, include_deprecated).cache(), lambda df: df.unpersist())

    def clear(self) -> None:
        with self.lock:
            for df in self.dimensions.values():
                df.unpersist()
            self.documents.clear()
            self.dimensions.clear()
            self.hits = self.misses = 0
