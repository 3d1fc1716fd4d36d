"""Public vocabularies, loaded once per Python worker."""

from __future__ import annotations

import base64

import numpy as np

CACHED_WORDS = 300_000
#: Text on which both libraries must agree before the faster one is used.
PROBE = "Hello world's 2024 naïve  co-op\n\n\t<|endoftext|> 日本 ... ‘x’ don't \r\n end "


class ByteBpe:
    """ids(text) -> little-endian uint32 bytes of the ids that `tokenizers` gives without special tokens; their strings in a text are ordinary text.

    The ids are those of the JSON vocabulary. Its merges are run by tiktoken on
    the same vocabulary as ranks, some four times faster; a probe at loading
    and the tests hold the two against each other.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.ids(PROBE) != self.whole(PROBE):
            raise ValueError(f"{path} and its ranks don't agree")

    def whole(self, text: str) -> bytes:
        """The ids by `tokenizers` itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes() if text else b""


class Pieces:
    """ids(words) -> the uint16 ids of a sentencepiece model with byte fallback, word by word; byte: which ids stand for single bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.model.get_piece_size())])
        self.cache: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if new := [w for w in dict.fromkeys(words) if w not in cache]:
            if len(cache) + len(new) > CACHED_WORDS:
                cache.clear()
                new = list(dict.fromkeys(words))
            for w, e in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True):
                cache[w] = np.array(e, dtype="<u4").tobytes()
        return np.frombuffer(b"".join([cache[w] for w in words]), dtype="<u4")


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_LOADED: dict = {}


def loaded(kind, name: str):
    """One vocabulary with its cache per Python worker; `name`: a file of the public tokenizers, or a path."""
    if (kind, name) not in _LOADED:
        _LOADED[kind, name] = kind(name if "/" in name else public_path(name))
    return _LOADED[kind, name]
