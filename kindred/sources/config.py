"""Settings from a JSON file."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class SearchConfig:
    terms_relevance_file: str
    stopwords_file: str
    use_word_vectors: bool
    dir_path: str = "."
    nr_shards: int = 64
    shard_size: int = 250_000_000
    bucket_size: int = 2_500
    id_size: int = 6
    toponyms_file: str | None = None
    synonyms_file: str | None = None
    i2q_file: str | None = None
    words_file: str | None = None
    word_vecs_file: str | None = None
    vector_size: int = 300

    @classmethod
    def from_json(cls, path: str) -> SearchConfig:
        given = json.loads(Path(path).read_text())
        for name in ("terms_relevance_file", "stopwords_file", "use_word_vectors"):
            if name not in given:
                raise ValueError(f"{path} does not set {name}")
        for name in ("toponyms_file", "synonyms_file", "i2q_file"):
            if name not in given:
                warnings.warn(f"{path} does not set {name}", stacklevel=2)
        known = {f.name for f in fields(cls)}
        return cls(**{"dir_path": str(Path(path).parent)} | {k: v for k, v in given.items() if k in known})

    def path(self, name: str | None) -> str | None:
        """Where a file of the settings is: beside the others, unless it says so itself."""
        return None if name is None else name if "/" in name else f"{self.dir_path}/{name}"
