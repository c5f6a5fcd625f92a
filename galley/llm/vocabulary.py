"""Vocabulary files of byte-level BPE tokenizers, read once on the driver and broadcast (about 2 MB at most)."""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import pretokens
from .common import tidy

_READY: dict[tuple[str, str], object] = {}
MOST_BYTES = 64 << 20


class Vocabulary:
    """``path`` names a ``.tiktoken`` rank file or a byte-level BPE ``tokenizer.json`` on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            raise ValueError(f"{path} is larger than a vocabulary may be")
        self.kind = "json" if data.lstrip()[:1] == b"{" else "ranks"
        self.key = hashlib.sha256(data).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def _once(self, what: str, make: Callable[[], object]):
        if (self.key, what) not in _READY:
            _READY[self.key, what] = make()
            tidy()  # what it was made from
        return _READY[self.key, what]

    def ranks(self) -> dict[bytes, int]:
        return self._once("ranks", lambda: (pretokens.ranks_of_json if self.kind == "json" else pretokens.ranks_of_tiktoken)(self.data.value))

    def encode(self):
        return self._once("encode", lambda: pretokens.encoder(self.ranks()))

    def added(self) -> dict[str, int]:
        """Tokens that a ``tokenizer.json`` adds to its model: they are matched in texts before anything else."""

        def make() -> dict[str, int]:
            found = json.loads(self.data.value).get("added_tokens", []) if self.kind == "json" else []
            if any(t.get(k) for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("an added token that looks at its surroundings isn't supported")
            return {t["content"]: t["id"] for t in found}

        return self._once("added", make)

    def split(self, text: str) -> list:
        """The text cut at added tokens, whose ids stand between its parts; the leftmost counts, then the longest."""
        added = self.added()
        if not any(t in text for t in added):
            return [text]
        cut = self._once("cut", lambda: re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")"))
        return [added[x] if i % 2 else x for i, x in enumerate(cut.split(text))]

    def token_bytes(self):
        """(bytes of all tokens one after another, offsets): the token-byte table."""
        import numpy as np

        def make():
            ranks = self.ranks()
            table = [b""] * (max(ranks.values()) + 1)
            for token, i in ranks.items():
                table[i] = token
            return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])])

        return self._once("bytes", make)
