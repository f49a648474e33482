"""Token counters: functions from a text to a number that can be sent to executors."""

from __future__ import annotations

import base64
import hashlib
import os

from .functions.text import ESTIMATE
from .operators.chunking import estimate

#: Public encodings that can be asked for by name, where their vocabulary is in tiktoken's cache.
ENCODINGS = ("cl100k_base", "o200k_base")
#: How a text is cut before tokens are merged, where a vocabulary comes from a file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


class Bpe:
    """Counts the tokens of a named encoding; loads it once in each process."""

    def __init__(self, name: str):
        self.name = name

    def _load(self):
        import tiktoken

        return self.name, lambda: tiktoken.get_encoding(self.name)

    def __call__(self, text: str) -> int:
        key, load = self._load()
        if key not in _loaded:
            _loaded[key] = load()
        return len(_loaded[key].encode(text, disallowed_special=()))


class Vocabulary(Bpe):
    """Counts the tokens of a vocabulary in a file of base64 tokens and their ranks. The file is read here, on the driver, and goes to the executors with the counter."""

    def __init__(self, path: str, pattern: str = PATTERN):
        super().__init__(os.path.basename(path).partition(".")[0])
        self.pattern = pattern
        with open(path, "rb") as f:
            self.source = f.read()
        self.key = hashlib.sha256(self.source + pattern.encode()).hexdigest()

    def _load(self):
        def load():
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.source.splitlines()) if a}
            return tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

        return self.key, load


def counter(name: str = ESTIMATE):
    """The counter of a name: the estimate, which needs no vocabulary; a public encoding; or the path of a vocabulary."""
    if name == ESTIMATE:
        return estimate
    if name in ENCODINGS:
        return Bpe(name)
    if os.path.isfile(name):
        return Vocabulary(name)
    raise ValueError(f"no such encoding: {name}; there are {', '.join((ESTIMATE, *ENCODINGS))}, and files of vocabularies")


def shown(name: str) -> str:
    """How an encoding is called in the column encoding: a vocabulary by its file's name."""
    return name if name in (ESTIMATE, *ENCODINGS) else os.path.basename(name).partition(".")[0]
